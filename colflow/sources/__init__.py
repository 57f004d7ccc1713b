"""Catalog and statement sources, plan harvest, lineage sink."""
