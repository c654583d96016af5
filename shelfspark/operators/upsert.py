"""Upserts as one aggregation over old and new rows (K1-K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(rows: DataFrame, keys: list[str], order: list[str], overwrite: list[str], keep: list[str], empty_counts: bool = True) -> DataFrame:
    """The state after applying ``rows`` in ``order`` (its last column must be unique per key).

    overwrite: the last row's value counts, null too. keep: the last non-null value counts
    (``empty_counts=False``: the last that isn't empty either). One pass with partial aggregation
    in the tasks, so a key with many versions sends one row per task. Rows with a null key form
    one key; an empty table gives none.
    """
    seq = F.struct(*order)
    value = lambda c: F.col(c) if empty_counts else F.when(F.col(c).cast("string") != "", F.col(c))
    aggs = [F.max_by(c, seq).alias(c) for c in overwrite]
    aggs += [F.max_by(value(c), F.when(value(c).isNotNull(), seq)).alias(c) for c in keep]
    return rows.groupBy(*keys).agg(*aggs)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """K4: every key's last row, whole."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def refresh(stored: DataFrame, pages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """K5: (rows to keep, rows to delete): a stored row whose page is there but is no product's
    any more (``is_product`` false) goes, all others stay."""
    gone = pages.filter("not is_product").select(key).distinct()
    return stored.join(gone, key, "left_anti"), stored.join(gone, key, "left_semi")
