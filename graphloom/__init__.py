"""A Spark-native engine for evidence-carrying property graphs and training-data pipelines."""
