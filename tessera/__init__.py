"""tessera: a Spark-native source-intelligence and data-pipeline engine."""
