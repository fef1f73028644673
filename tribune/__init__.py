"""Speech search, attendance analytics and their ingestion as Spark jobs."""
