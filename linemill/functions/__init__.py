"""Column functions: patterns, character sets, fields, replacement, formatting."""
