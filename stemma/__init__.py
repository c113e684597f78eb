"""Textual-witness analytics and corpus preparation on Spark."""
