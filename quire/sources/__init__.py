"""Reading files as relations, in batches or as they arrive."""
