"""Reading and writing RDF: N-Triples, Turtle, RDF/XML and a quad store."""
