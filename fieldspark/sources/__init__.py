"""Readers of observation files."""
