"""Evidence retrieval, verification and corpus processing as Spark DataFrame jobs."""
