"""Evidence retrieval over long documents, as Spark DataFrame transforms."""
