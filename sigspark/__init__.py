"""Spark-native analytics over piecewise-constant traces, with a small s-expression query language."""
