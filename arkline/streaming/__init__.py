"""Catalog streaming."""
