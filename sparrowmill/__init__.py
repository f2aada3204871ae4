"""sparrowmill: DataFrame-to-DataFrame operators for PySpark."""
