"""Register analytics on Spark: loading, reconciling, ranking, searching."""
