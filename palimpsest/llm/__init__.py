"""Operators of a training-data pipeline; nothing else in the library needs them."""
