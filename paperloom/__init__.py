"""paperloom: a Spark-native engine for building, ranking and querying a research-paper corpus."""
