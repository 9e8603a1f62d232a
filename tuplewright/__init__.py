"""A Spark-native engine for recursive, rule-based analysis of relations of facts."""
