"""recollect: memory retrieval and consolidation as Spark DataFrame plans."""
