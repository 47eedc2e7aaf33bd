"""Operators for building training corpora with Spark.

Nothing outside this subpackage imports it. ``queries`` holds the registered
queries and their reference SQL; each other module is one operator.
"""
