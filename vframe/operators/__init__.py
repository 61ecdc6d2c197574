"""Operators on migrated records: policies, arrays, access."""
