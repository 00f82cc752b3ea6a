"""Readers and writers: driver tables, `::` text files, feature Parquet, keyed store."""
