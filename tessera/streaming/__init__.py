"""Incremental runs and event windows."""
