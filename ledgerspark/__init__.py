"""A Spark-native analytics engine for financial documents."""
