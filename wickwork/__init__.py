"""wickwork: daily-bar pattern analytics as Spark DataFrame jobs."""
