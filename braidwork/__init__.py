"""Spark-first analytics: source-code facts, graph and tiered joins, and training-data operators."""
