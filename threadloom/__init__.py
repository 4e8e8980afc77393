"""threadloom: a Spark-first engine for customer-conversation analytics."""
