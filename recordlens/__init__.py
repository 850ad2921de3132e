"""Record, conversation and crawl analytics as Spark jobs."""
