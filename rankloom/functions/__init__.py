"""Column-level helpers: vectors, hashing, binning, genre encoding, scalars."""
