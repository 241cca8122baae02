"""Text search, ranking and analytics expressed as Spark DataFrame plans."""
