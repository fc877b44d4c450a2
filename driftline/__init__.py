"""driftline: Spark-native before/after analytics on large collections of series."""
