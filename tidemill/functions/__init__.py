"""Spark-first building blocks of the message-flow engine."""
