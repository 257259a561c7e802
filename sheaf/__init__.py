"""Document analytics on Spark: DataFrame-first operators for document collections."""
