"""Whole plans: the stored index, the service over it and its command line."""
