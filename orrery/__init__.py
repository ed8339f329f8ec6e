"""Versioned entity-graph analytics on Spark."""
