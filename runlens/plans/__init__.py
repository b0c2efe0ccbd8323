"""Composite queries: charts, smoothers, change sets."""
