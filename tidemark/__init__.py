"""tidemark: Spark-native analytics for regular, multi-site time series."""
