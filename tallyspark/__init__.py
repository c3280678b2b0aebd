"""tallyspark: embedding-benchmark analytics as Spark DataFrame transformations."""
