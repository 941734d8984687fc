"""Operators of a training-data pipeline.

``registry.queries()`` and ``registry.oracle_sql()`` list the registered queries. Nothing
outside this package imports it, except ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
