"""Readers and writers: id-range chunks, delimited text, splits, metrics, model state."""
