"""RDF graph analytics as Spark DataFrame jobs."""
