"""Contact and engagement analytics on Spark: DataFrame in, DataFrame out."""
