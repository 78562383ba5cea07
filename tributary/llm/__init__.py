"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it.  Each operator is a module with a
general interface; ``queries`` holds the registered queries on top of them.
"""
