"""quern: a Spark-native engine for set relations, rules and record pipelines."""
