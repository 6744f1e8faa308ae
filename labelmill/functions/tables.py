"""Rows out of a row, for SQL: table functions that a LATERAL join calls.

They are SQL functions, so their bodies become part of the plan of whoever calls them: a generator, no Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from labelmill.functions.text import LINE_BULLET, LINE_BREAK, MASK_BULLET, WHITE


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_TABLES = {
    # bullets as the validity mask counts them
    "bullets": ("said STRING", "pos INT, bullet STRING", f"SELECT pos, trim(TRAILING {_quoted(WHITE)} FROM col) FROM posexplode(regexp_extract_all(coalesce(said, ''), {_quoted(MASK_BULLET)}, 1))"),
    # lines that begin like a claim of a report
    "claim_lines": ("said STRING", "pos INT, claim STRING", f"SELECT pos, trim(BOTH {_quoted(WHITE)} FROM regexp_extract(col, {_quoted(LINE_BULLET)}, 1)) FROM posexplode(filter(split(coalesce(said, ''), {_quoted(LINE_BREAK)}, -1), x -> x RLIKE {_quoted(LINE_BULLET)}))"),
    # the places of a range, one by one; none if it is empty
    "token_places": ("first_place BIGINT, end_place BIGINT", "place BIGINT", "SELECT explode(CASE WHEN end_place > first_place THEN sequence(first_place, end_place - 1) ELSE cast(array() AS array<bigint>) END)"),
    # a row for each of n candidates
    "candidates": ("n INT", "candidate INT", "SELECT explode(CASE WHEN n > 0 THEN sequence(0, n - 1) ELSE cast(array() AS array<int>) END)"),
}


def with_table_functions(spark: SparkSession) -> SparkSession:
    """spark, which now knows bullets(said), claim_lines(said), token_places(first, end) and candidates(n)."""
    for name, (given, made, body) in _TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE ({made}) RETURN {body}")
    return spark
