"""Column builders: geometry, units, predicates and engineering rule tables."""
