"""Brindle: a PySpark-native analytics library (typed queries, ledgers, streams, signals)."""
