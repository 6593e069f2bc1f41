"""tessera: a Spark-native analytics engine for snapshot-style data."""
