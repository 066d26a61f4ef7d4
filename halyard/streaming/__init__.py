"""A bounded update log as a stream: the table of live vectors, kept by micro-batches."""
