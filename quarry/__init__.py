"""A document search and analytics engine whose operators are Spark DataFrame plans."""
