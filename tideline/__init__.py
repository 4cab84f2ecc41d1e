"""tideline: a Spark-native analytics engine for timestamped media tables."""
