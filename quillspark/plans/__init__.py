"""Composite plans and the catalog of queries."""
