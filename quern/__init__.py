"""quern: retrieval, ranking and corpus preparation expressed as Spark plans."""
