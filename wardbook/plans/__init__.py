"""Queries by name: SQL views, the table function, the catalogue, the registered checks."""
