"""Column functions: text, identifiers, units."""
