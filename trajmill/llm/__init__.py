"""Operators of a training-data pipeline over text tables; nothing else in the library imports them."""
