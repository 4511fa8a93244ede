"""Catalog operators."""
