"""tablemill: Spark jobs over tables, from ingest to published, checked versions."""
