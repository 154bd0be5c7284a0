"""Archives from unbounded input: micro-batches are upserted into a table, from which the archive is built."""
