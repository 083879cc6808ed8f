"""Phone-sensing features and cohort analysis as Spark jobs."""
