"""Findings: every rejected row as (check_id, key, detail), instead of the first one raised."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed_checks(checks: Mapping[str, Column]) -> Column:
    """The names of the checks whose condition (true = bad, null = bad) holds, as an array."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in checks.items()])
    )


def finding(df: DataFrame, check_id: str, key: Column | str, detail: Column | str = "") -> DataFrame:
    key_col = F.col(key) if isinstance(key, str) else key
    detail_col = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(check_id).alias("check_id"), key_col.alias("key"), detail_col.alias("detail"))


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assert_valid(findings: DataFrame) -> None:
    """Raise when anything was found, naming the first few."""
    first = findings.take(5)
    if first:
        named = "; ".join(f"{r['check_id']}: {r['key']} {r['detail']}".strip() for r in first)
        raise ValueError(f"input rejected: {named}")
