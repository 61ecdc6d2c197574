"""Record types, migrations and their compilation to projections."""
