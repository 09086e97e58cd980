"""arachne: a Spark-native graph analytics engine."""
