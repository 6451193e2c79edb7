"""Document analytics on Spark: extraction, normalisation, comparison, retrieval."""
