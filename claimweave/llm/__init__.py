"""Operators of a training-data pipeline; no other part of the library imports this one."""
