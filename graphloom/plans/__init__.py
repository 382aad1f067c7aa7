"""Plans of the property-graph engine."""
