"""Incremental runs over arriving pages."""
