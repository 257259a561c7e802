"""Queries: operators bound to tables, with their SQL."""
