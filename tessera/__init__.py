"""Tessera: a PySpark-native analytics engine (operators, functions, sources, streaming)."""
