"""Helpers that shape physical plans: lineage cuts and table access."""
