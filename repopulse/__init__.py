"""repopulse: growth analytics over source repositories, written as Spark jobs."""
