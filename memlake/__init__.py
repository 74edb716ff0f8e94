"""memlake: document-memory analytics on PySpark."""
