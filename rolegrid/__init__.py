"""rolegrid: job-posting analytics as Spark DataFrame operators."""
