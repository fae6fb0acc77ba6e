"""Quern: text-corpus analytics as composable Spark DataFrame operators."""
