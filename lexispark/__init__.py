"""lexispark: evidence retrieval, citation analytics and corpus preparation as Spark dataflows."""
