"""Readers and writers: RDF text, relational mappings, quads, benchmark files."""
