"""Streaming entry point."""
