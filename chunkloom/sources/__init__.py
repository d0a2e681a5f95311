"""Readers and format parsers."""
