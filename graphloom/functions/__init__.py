"""Column functions: text, identifiers, addresses, paths, values and requirements."""
