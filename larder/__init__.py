"""Saved-content analytics on PySpark."""
