"""sluiceway: a Spark-native engine for log routing and corpus preparation."""
