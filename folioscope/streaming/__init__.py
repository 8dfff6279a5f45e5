"""Beyond batch builds: keeping an index's chunks fresh from a stream of files."""
