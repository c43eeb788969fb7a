"""News-event statistics and training-data operators as Spark jobs."""
