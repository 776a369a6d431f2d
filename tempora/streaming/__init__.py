"""Structured Streaming forms of the ontology log."""
