"""Top N items within every group, by lower bounds of the partitions.

The n-th best distinct item that one partition holds of a group is a lower bound of the group's
true n-th best score: n items reach it already. A first pass over groups, items and scores states
every task's bounds; the greatest of each group is joined back to the rows where they are read, rows
under it go, and only then the survivors, at most n a group and task, move into their ranking. Few
bounds (their number is counted) are sent to the tasks; more are joined to what the tasks keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

#: Rows a task gathers before it drops those that can't be among its best.
BUFFER_ROWS = 200_000
#: Most bounds that are sent to every task.
SENT_BOUNDS = 200_000


def _best(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The first n distinct items of every group in the order (score descending, tie)."""
    codes, _ = pd.factorize(rows["_g"])
    rows = rows.iloc[np.lexsort((rows["_t"].to_numpy(), -rows["_s"].to_numpy(), codes))]
    rows = rows[~rows.duplicated(["_g", "_i", "_in"])]
    return rows[rows.groupby("_g", sort=False).cumcount() < n]


def _kept(frames: Iterator[pd.DataFrame], n: int) -> pd.DataFrame | None:
    """A task's best n items of every group; never more than these and a buffer are held."""
    held: list[pd.DataFrame] = []
    size, limit = 0, BUFFER_ROWS
    for pdf in frames:
        held.append(pdf)
        size += len(pdf)
        if size >= limit:
            held = [_best(pd.concat(held, ignore_index=True), n)]
            size = len(held[0])
            limit = max(BUFFER_ROWS, 2 * size)
    return _best(pd.concat(held, ignore_index=True), n) if size else None


def _bounds(n: int):
    """(group, bound) of the groups of which a task holds n items."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _kept((pdf.assign(_t=0) for pdf in frames), n)
        if best is not None:
            of = best.groupby("_g", sort=False)["_s"].agg(["size", "min"])
            of = of[of["size"] == n]
            yield pd.DataFrame({"_g": of.index.to_numpy(), "_b": of["min"].to_numpy()})

    return run


def _local(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _kept(frames, n)
        if best is not None:
            yield best

    return run


def top_n(rows: DataFrame, group: str, score: str, item: str, tie: str, n: int = 5) -> DataFrame:
    """The n best items of every group: group, rank_no (from 1), tie, item, score.

    Greater ``score`` first, then smaller ``tie`` (a unique bigint; of repeated rows one counts).
    An item counts once per group, with its best row in the same order; null is an item of its
    own. Rows whose group, score or tie is null, or whose score is NaN, don't count. Groups with
    fewer than n items give fewer rows, an empty table none. Other columns are ignored, so their
    names can't clash.
    """
    schema = {f.name: f.dataType for f in rows.schema}
    null_item = F.lit("" if schema[item].simpleString() == "string" else 0).cast(schema[item])
    data = rows.select(
        F.col(group).alias("_g"), F.col(score).cast("double").alias("_s"), F.coalesce(F.col(item), null_item).alias("_i"),
        F.col(item).isNull().alias("_in"), F.col(tie).cast("long").alias("_t"),
    ).filter(F.col("_g").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s") & F.col("_t").isNotNull())
    types = {f.name: f.dataType.simpleString() for f in data.schema}
    kinds = ", ".join(f"{c} {t}" for c, t in types.items())
    stated = data.select("_g", "_s", "_i", "_in").mapInPandas(_bounds(n), f"_g {types['_g']}, _b double")
    bounds = cut_lineage(stated.groupBy("_g").agg(F.max("_b").alias("_b")))
    reach = F.col("_b").isNull() | (F.col("_s") >= F.col("_b"))
    of_group = Window.partitionBy("_g")
    if bounds.limit(SENT_BOUNDS + 1).count() <= SENT_BOUNDS:
        kept = data.join(F.broadcast(bounds), "_g", "left").filter(reach).drop("_b").mapInPandas(_local(n), kinds).repartition("_g")  # once for both rankings
    else:
        kept = data.mapInPandas(_local(n), kinds).join(bounds, "_g", "left").filter(reach).drop("_b")
    order = [F.col("_s").desc(), F.col("_t").asc()]
    once = kept.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "_i", "_in").orderBy(*order))).filter("_k = 1")
    ranked = once.withColumn("rank_no", F.row_number().over(of_group.orderBy(*order))).filter(F.col("rank_no") <= n)
    return ranked.select(
        F.col("_g").alias(group), "rank_no", F.col("_t").alias(tie), F.when(~F.col("_in"), F.col("_i")).alias(item), F.col("_s").alias(score)
    )
