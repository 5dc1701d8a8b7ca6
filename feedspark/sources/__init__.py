"""Readers: driver tables, stand-in views, article CSV, artifacts, paged search source."""
