"""Column functions on RDF terms, and functions called by IRI."""
