"""Operators for preparing language-model training text with Spark.

Nothing outside this subpackage imports it; the queries and their SQL are in
``rasterloom.llm.queries``.
"""
