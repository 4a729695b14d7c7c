"""Freshness: change events, pending files, when to rebuild."""
