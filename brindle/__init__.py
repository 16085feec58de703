"""brindle: a Spark-first retrieval and relational analytics engine."""
