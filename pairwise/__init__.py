"""Pair features and model consensus as Spark DataFrame operators."""
