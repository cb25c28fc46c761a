"""conceptflow: a PySpark-native engine that grows a concept hierarchy out of a corpus."""
