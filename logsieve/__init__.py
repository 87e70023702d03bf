"""Spark-native log-anomaly analytics: composable DataFrame-to-DataFrame operators."""
