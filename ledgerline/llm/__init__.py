"""Operators of a training-data pipeline: each module is one operator, usable on any DataFrame."""
