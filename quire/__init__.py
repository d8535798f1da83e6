"""quire: Spark jobs that turn paged documents into structured knowledge."""
