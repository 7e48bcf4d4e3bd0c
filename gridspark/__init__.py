"""A DataFrame-native engine for gridded measurements: positions crossed with spectroscopic steps."""
