"""tidemark: market-data analytics written as Spark DataFrame jobs."""
