"""Spark-native monitoring of planning documents: sources, operators, state, streaming and plans."""
