"""Registered queries with their SQL: each module has a list of Query entries."""
