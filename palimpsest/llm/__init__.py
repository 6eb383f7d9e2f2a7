"""Operators of a training-data pipeline: each module has one operator, `queries` registers them."""
