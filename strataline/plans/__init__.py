"""Pipelines, the facade and the named queries."""
