"""Incremental sessions."""
