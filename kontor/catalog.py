"""All queries of the core, by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kontor.plans import aggregates, joins, planning, records, resolving, sources, texts

FLAGSHIP = "mail_per_language"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**sources.QUERIES, **joins.QUERIES, **aggregates.QUERIES, **texts.QUERIES, **records.QUERIES, **resolving.QUERIES, **planning.QUERIES}
SQL: dict[str, str] = {**sources.SQL, **joins.SQL, **aggregates.SQL, **texts.SQL, **records.SQL, **resolving.SQL, **planning.SQL}
