"""Continuous ingestion of triples."""
