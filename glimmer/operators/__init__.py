"""Encoding, decoding, rendering and analytics as transformations of DataFrames."""
