"""tidemark: a Spark-first analytics engine."""
