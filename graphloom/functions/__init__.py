"""Functions of the property-graph engine."""
