"""Readers, adapters, importers and writers."""
