"""Readers: control tables, seeds, staging layouts, page snapshots."""
