"""Catalog plans."""
