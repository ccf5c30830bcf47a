"""Registered queries over the test tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import book_queries, corpus_queries, layout_queries, scan_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = corpus_queries.QUERIES | layout_queries.QUERIES | book_queries.QUERIES | scan_queries.QUERIES
ORACLE_SQL: dict[str, str] = corpus_queries.ORACLE | layout_queries.ORACLE | book_queries.ORACLE | scan_queries.ORACLE
