"""quillspark: text search, vector, graph and event analytics as Spark DataFrame jobs."""
