"""Similarity analytics on Spark: trees, neighbours, closest pairs and skew-proof aggregation."""
