"""Change-history analytics on PySpark: DataFrame in, DataFrame out."""
