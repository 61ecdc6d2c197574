"""Types and codecs as Column expressions."""
