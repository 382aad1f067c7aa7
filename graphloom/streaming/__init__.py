"""Streaming of the property-graph engine."""
