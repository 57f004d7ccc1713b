"""Queries over the test tables: statement corpora, templates, data queries."""
