"""sievework: a Spark-first engine that turns document text into clean key/value tables and measures the result."""
