"""strataframe: Spark-native document retrieval, rule analytics and corpus processing."""
