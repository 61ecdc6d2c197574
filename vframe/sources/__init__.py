"""Readers and writers of record documents."""
