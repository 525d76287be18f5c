"""Governed analytics on Spark: every SQL question passes a chain of controls before any task starts."""
