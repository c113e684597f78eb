"""Queries bound to tables, with their SQL."""
