"""DataFrame operators over point, run, text and media tables."""
