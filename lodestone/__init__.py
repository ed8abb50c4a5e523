"""Filing analytics on Spark: every operator is a plain DataFrame -> DataFrame function."""
