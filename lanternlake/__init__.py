"""Spark-first hybrid retrieval, conversation analytics and corpus curation."""
