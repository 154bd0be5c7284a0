"""Archives as tables: byte ranges, the archive itself, and its Spark data source."""
