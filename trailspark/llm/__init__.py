"""Operators for model-training text and agent logs. Nothing else in the library imports this."""
