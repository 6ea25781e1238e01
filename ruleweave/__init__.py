"""Default-rule mining on Spark: readable rules with exceptions from labelled tables."""
