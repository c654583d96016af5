"""Ranking, quotas, samples and first-wins (W1-W16, U4, U5). Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank_no") -> DataFrame:
    """The k first rows of every group; Spark limits groups inside the tasks first."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def quota_top_k(rows: DataFrame, group: list[str], quota: str, order: list[Column], per_quota: int, k: int) -> DataFrame:
    """The k first rows of a group with at most ``per_quota`` of one ``quota`` value.

    Taking greedily in order is the same as ranking within (group, quota) first and ranking what
    is within the quota afterwards: whether a row is over its quota depends only on the rows of
    the same quota value before it.
    """
    return top_k(top_k(rows, [*group, quota], order, per_quota, "_q").drop("_q"), group, order, k)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every key's first row in the order, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def even_sample(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """``most`` rows of every group at even distances, the first and the last among them."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    if most <= 0:
        return ranked.filter(F.lit(False)).drop("_i", "_n")
    if most == 1:
        return ranked.filter("_i = 0").drop("_i", "_n")
    # i is taken iff some j has i = bround(j (n-1) / (m-1)); the candidates are next to i (m-1) / (n-1)
    j = F.col("_i") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    hits = [F.bround((F.floor(j) + d) * (F.col("_n") - 1) / (most - 1)).cast("long") == F.col("_i") for d in (-1, 0, 1, 2)]
    inside = [(F.floor(j) + d >= 0) & (F.floor(j) + d <= most - 1) for d in (-1, 0, 1, 2)]
    taken = F.lit(False)
    for hit, within in zip(hits, inside):
        taken = taken | (hit & within)
    return ranked.filter((F.col("_n") <= most) | taken).drop("_i", "_n")


def hash_sample(rows: DataFrame, group: list[str], key: Column, salt: str, k: int) -> DataFrame:
    """K rows of every group in the order of a hash of their key: a sample that is the same
    on every run and doesn't depend on how rows are stored."""
    h = F.sha2(F.concat_ws("|", F.lit(salt), *[F.col(g).cast("string") for g in group], key), 256)
    return top_k(rows.withColumn("_h", h), group, [F.col("_h").asc(), key.asc()], k).drop("_h")
