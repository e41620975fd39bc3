"""Readers of files."""
