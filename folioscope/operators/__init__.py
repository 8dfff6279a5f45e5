"""The engine's operators over tables of chunks, terms, vectors and references."""
