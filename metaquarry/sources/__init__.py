"""Readers and writers: codebook XML, XML schemas, RDF text, JSON."""
