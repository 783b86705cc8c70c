"""Spark-native engine for statistical metadata: codebooks, knowledge graphs and the plans that query them."""
