"""The query catalogue: test tables, command batches, Spark queries and their SQL counterparts."""
