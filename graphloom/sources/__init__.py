"""Sources of the property-graph engine."""
