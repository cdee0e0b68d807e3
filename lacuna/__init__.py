"""lacuna: a Spark-native engine that resolves damaged text fragments against a corpus."""
