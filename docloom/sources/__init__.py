"""Readers and decoders for files and tables."""
