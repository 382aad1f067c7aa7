"""Operators of the property-graph engine."""
