"""Operators over the lineage tables."""
