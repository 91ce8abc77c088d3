"""Conversational memory-graph analytics as Spark DataFrame operators."""
