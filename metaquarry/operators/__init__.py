"""Operators on codebooks, graphs and resources."""
