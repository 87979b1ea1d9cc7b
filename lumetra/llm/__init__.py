"""Training-data operators on Spark: one module an operator, ``queries`` for the registered digests."""
