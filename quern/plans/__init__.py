"""Queries that run whole catalogue plans: name, callable and SQL."""
