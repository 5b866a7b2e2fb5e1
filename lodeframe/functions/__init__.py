"""Column functions: scalar semantics, units, normal scores."""
