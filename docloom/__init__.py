"""Document knowledge bases on Spark: ingestion, retrieval, metadata and corpus preparation as DataFrame operators."""
