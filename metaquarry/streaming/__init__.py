"""Streaming ingestion of codebooks and triples."""
