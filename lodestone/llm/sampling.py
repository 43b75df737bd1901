"""Bounded samples that don't depend on how a table is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_RANGE = 1 << 30


def hash_sample(rows: DataFrame, key: str, total: int, most: int) -> DataFrame:
    """About most * 1.2 rows, those with small hashes of a key that is unique or nearly so; never more than
    2 * most. The filter runs where the rows are read, so what any task passes on is its share of the sample."""
    share = min(1.0, 1.2 * most / max(total, 1))
    return rows.where(F.pmod(F.xxhash64(key), F.lit(_RANGE)) < F.lit(int(share * _RANGE))).limit(2 * most)
