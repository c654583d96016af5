"""Filling fixed-capacity containers with items of varying size.

Bounded-space online best fit: a task keeps a fixed number of open containers, found through a
bitset whose bit f says that a container with f units free is open. An item goes where it leaves
the least room: the lowest set bit at or above its size. When no open container takes it and the
number is reached, the fullest closes. What a task has open at its end goes, container by
container, through a second pass over few tasks, so the ends of many tasks don't add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

CAPACITY = 2048
OPEN = 64
#: Tasks whose last open containers are packed together in the second pass.
MERGE = 64


class BestFit:
    """Containers open at one time; ``put`` gives the number of the container an item goes to."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN) -> None:
        self.capacity, self.most = capacity, open_bins
        self.bits, self.by_free = 0, {}
        self.made = self.open = 0

    def put(self, size: int) -> int:
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.capacity
            self.made += 1
        if free > size:
            left = free - size
            self.bits |= 1 << left
            self.by_free.setdefault(left, []).append(number)
            self.open += 1
        return number

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def cuts(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item: one, unless it alone exceeds a container."""
    if size <= capacity:
        return [(0, size)]
    return [(s, min(capacity, size - s)) for s in range(0, size, capacity)]


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, open_bins: int = OPEN) -> DataFrame:
    """Assigns items to containers: key, piece_no (from 0), start, length, container (string).

    An item larger than a container is cut into full pieces and a rest; others stay whole. Null
    and negative sizes count as 0; items of size 0 go to a container without taking room. Every
    row is an item of its own, repeated keys too. Containers hold at most ``capacity``; their
    names are stable as long as the input is read in the same partitions. An empty table gives
    none; other columns are ignored.
    """
    kind = sizes.schema[key].dataType.simpleString()
    items = sizes.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n"), F.spark_partition_id().alias("p"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, task = BestFit(capacity, open_bins), 0
        for batch in batches:
            ks, pieces, starts, lengths, bins = [], [], [], [], []
            keys = batch.column(0)
            for i, (n, task) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for no, (start, length) in enumerate(cuts(n, capacity)):
                    b = fit.put(length)
                    ks.append(i), pieces.append(no), starts.append(start), lengths.append(length), bins.append(b)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(ks, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([task] * len(ks), pa.int32()), pa.array(bins, pa.int64())],
                ["k", "piece_no", "start", "length", "task", "bin"],
            )

    placed = items.mapInArrow(first, f"k {kind}, piece_no int, start bigint, length bigint, task int, bin bigint")
    placed = cut_lineage(placed)  # read twice below, and what it is made of is dear
    # Second pass over containers, not items: those that aren't full enough are themselves packed.
    fills = placed.groupBy("task", "bin").agg(F.sum("length").alias("fill"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits: dict[int, BestFit] = {}
        for batch in batches:
            group, task, number, fill = (batch.column(i).to_pylist() for i in range(4))
            to = [fits.setdefault(g, BestFit(capacity, open_bins)).put(f) for g, f in zip(group, fill)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([f"{g}-{t}" for g, t in zip(group, to)], pa.string())], ["task", "bin", "container"])

    group = F.floor(F.col("task") / MERGE).cast("int")
    loose = fills.filter(F.col("fill") <= capacity // 2)
    merged = (
        loose.select(group.alias("g"), "task", "bin", "fill").repartition("g").sortWithinPartitions("g", F.col("fill").desc(), "task", "bin")
        .mapInArrow(second, "task int, bin bigint, container string")
    )
    return placed.join(merged, ["task", "bin"], "left").select(
        F.col("k").alias(key), "piece_no", "start", "length", F.coalesce(F.concat(F.lit("m"), "container"), F.concat_ws("-", F.lit("c"), "task", "bin")).alias("container")
    )
