"""Bitemporal history of changing attributes.

``ledger`` turns a stream of observations ("entity X was in state S at instant V", recorded in the
order ``seq``) into a bitemporal ledger: every row holds a state, the period it was valid for and
the span of recording over which the ledger said so. A late observation splits the period it falls
into; the row it splits is closed, never overwritten, and the remainder is written as a new row.

The sweep. Sort an entity's observations by instant and link them in a list; then take them out
again in the reverse order of recording. At the moment one is taken out, its neighbours in the
list are the nearest earlier and later instants that were known when it was recorded, which is the
period it split. Each observation closes at most one row and opens at most two, so the ledger
holds at most twice as many rows as there are observations.

Hot entities. An entity with more than ``hot_rows`` observations is cut into segments of about
that size along the axis of validity, ``SEGMENTS`` at most. The sweep runs within segments; a
neighbour that lies in another segment is found afterwards by an as-of search over that segment's
record of extremes, so no task ever holds more than a segment. Which entities are hot stays a table;
nothing of it is collected, and it is sent to the tasks only where AQE finds it small. Finding them
reads entities and instants once before the observations are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

#: Observations of one entity beyond which its history is cut into segments.
HOT_ROWS = 200_000
#: Most segments of one entity: 200 million rows before segments grow.
SEGMENTS = 1024


def _neighbours(at: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For observations sorted by (at, seq): row numbers of the nearest earlier and later instant
    known when each was recorded, and of the observation of the same instant it replaces; -1: none.
    """
    n = len(at)
    node = np.concatenate(([0], np.cumsum(at[1:] != at[:-1]))) if n else np.zeros(0, int)
    size = int(node[-1]) + 1 if n else 0
    left, right = list(range(-1, size - 1)), list(range(1, size + 1))
    before, after, same = [-1] * n, [-1] * n, [-1] * n
    same_node = node.tolist()
    for i in range(1, n):
        if same_node[i] == same_node[i - 1]:
            same[i] = i - 1
    # the newest observation of every instant that is still in the list
    top = [0] * size
    for i in range(n):
        top[same_node[i]] = i
    for i in np.argsort(-seq, kind="stable").tolist():
        k = same_node[i]
        if same[i] >= 0:
            top[k] = same[i]
            a, b = left[k], right[k]
            before[i] = top[a] if a >= 0 else -1
            after[i] = top[b] if b < size else -1
            continue
        a, b = left[k], right[k]
        before[i] = top[a] if a >= 0 else -1
        after[i] = top[b] if b < size else -1
        if a >= 0:
            right[a] = b
        if b < size:
            left[b] = a
    return np.array(before, int), np.array(after, int), np.array(same, int)


def _groups(ent: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Where the groups of sorted rows start, and their end."""
    if not len(ent):
        return np.array([0])
    return np.r_[0, np.flatnonzero((ent[1:] != ent[:-1]) | (seg[1:] != seg[:-1])) + 1, len(ent)]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of sorted rows that end where a group ends; (entity, segment) are columns 0 and 1."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ent, seg = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        cut = int(_groups(ent, seg)[-2])
        first = held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (ent[0], seg[0])
        if held and (first or cut):
            done = held if first else [*held, batch.slice(0, int(_groups(ent, seg)[1]))]
            yield pa.Table.from_batches(done)
            start = 0 if first else int(_groups(ent, seg)[1])
        else:
            start = 0
        if held and not first and not cut:
            held.append(batch)
            continue
        if cut > start:
            yield pa.Table.from_batches([batch.slice(start, cut - start)])
        held = [batch.slice(max(start, cut))]
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _unrepeated(table: pa.Table) -> pa.Table:
    """Of rows of one entity with one seq the first (the one with the smallest instant)."""
    ent, seq = table.column("_e").to_numpy(), table.column("_seq").to_numpy()
    order = np.lexsort((np.arange(len(seq)), seq, ent))
    again = np.r_[False, (ent[order][1:] == ent[order][:-1]) & (seq[order][1:] == seq[order][:-1])] if len(seq) else np.array([], bool)
    return table.take(np.sort(order[~again])) if again.any() else table


def _solve(table: pa.Table) -> tuple[np.ndarray, ...]:
    ent, seg = table.column("_e").to_numpy(), table.column("_seg").to_numpy()
    at, seq = table.column("_at").to_numpy(), table.column("_seq").to_numpy()
    before, after, same = (np.full(len(ent), -1, int) for _ in range(3))
    bounds = _groups(ent, seg)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo > 1:
            for to, v in zip((before, after, same), _neighbours(at[lo:hi], seq[lo:hi])):
                to[lo:hi] = np.where(v >= 0, v + lo, -1)
    return ent, at, seq, before, after, same


def _known(values: np.ndarray, index: np.ndarray) -> pa.Array:
    return pa.array(values[np.maximum(index, 0)] if len(values) else values, pa.int64(), mask=index < 0)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted observations to observations with the keys of their neighbours."""
    for table in _whole_groups(batches):
        table = _unrepeated(table)
        _, at, seq, before, after, same = _solve(table)
        out = table.select(["_e", "_seg", "_at", "_seq"])
        for name, values, index in (("_before_seq", seq, before), ("_before_at", at, before), ("_after_at", at, after), ("_same_seq", seq, same)):
            out = out.append_column(name, _known(values, index))
        yield from out.to_batches()


def _sweep_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted observations of whole entities to the rows of their ledgers."""
    for table in _whole_groups(batches):
        table = _unrepeated(table)
        ent, at, seq, before, after, same = _solve(table)
        n = np.arange(len(ent))
        split, gone = np.flatnonzero((before >= 0) & (same < 0)), np.flatnonzero(same >= 0)
        # what happens to an observation: it opens its row, its row is cut, it is replaced
        of = np.concatenate([n, before[split], same[gone]])
        when = np.concatenate([seq, seq[split], seq[gone]])
        end = np.concatenate([after, split, np.full(len(gone), -1)])
        closes = np.concatenate([np.zeros(len(n) + len(split), bool), np.ones(len(gone), bool)])
        order = np.lexsort((when, of))
        of, when, end, closes = of[order], when[order], end[order], closes[order]
        last = np.r_[of[1:] != of[:-1], True]
        until = pa.array(np.r_[when[1:], 0], pa.int64(), mask=last)
        # versions: an instant's newest observation against that of the instant before
        held = np.flatnonzero(np.r_[(ent[1:] != ent[:-1]) | (at[1:] != at[:-1]), True])
        starts = np.zeros(len(n), bool)
        fresh = np.r_[True, ent[held[1:]] != ent[held[:-1]]]
        state = [c for c in table.column_names if c.startswith("s")]
        for c in state:
            a, b = (table.column(c).combine_chunks().take(pa.array(i)) for i in (held[1:], held[:-1]))
            equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            fresh[1:] |= ~equal.to_numpy(zero_copy_only=False).astype(bool)
        starts[held] = fresh
        rows = ~closes
        take = pa.array(of[rows])
        columns = [pa.array(ent[of[rows]]), pa.array(at[of[rows]]), _known(at, end[rows]), *[table.column(c).combine_chunks().take(take) for c in state], pa.array(seq[of[rows]]), pa.array(when[rows]), until.filter(pa.array(rows)), pa.array(starts[of[rows]] & last[rows])]
        yield from pa.Table.from_arrays(columns, ["_e", "valid_from", "valid_to", *state, "_by", "recorded_from", "recorded_to", "starts_version"]).to_batches()


def _hot(obs: DataFrame, hot_rows: int) -> DataFrame | None:
    """(_e, cuts) of the entities with more than ``hot_rows`` observations, at most the
    ``hot_rows``-th part of all rows; None if there are none."""
    counts = cut_lineage(obs.groupBy("_e").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows))
    if counts.isEmpty():
        return None
    some = obs.join(counts, "_e").groupBy("_e").agg(F.first("n").alias("n"), F.approx_percentile("_at", F.lit([i / SEGMENTS for i in range(1, SEGMENTS)]), 100_000).alias("all"))
    step = F.greatest(F.floor(F.lit(SEGMENTS) * hot_rows / F.col("n")), F.lit(1))
    kept = F.filter("all", lambda _, i: (i + 1) % step == 0)
    return cut_lineage(some.select("_e", F.array_sort(F.array_distinct(kept)).alias("cuts")))


def _across(near: DataFrame) -> DataFrame:
    """Fills neighbours that lie in other segments of the same entity.

    Of an entity's segments only one small row each is needed to know which segment holds the
    neighbour: the nearest one that had any observation by then. Within it the neighbour is the
    extreme instant recorded up to then, an as-of search over that segment alone.
    """
    firsts = near.groupBy("_e", "_seg").agg(F.min("_seq").alias("f"))
    firsts = firsts.groupBy("_e").agg(F.collect_list(F.struct("_seg", "f")).alias("segs")).filter(F.size("segs") > 1)  # SEGMENTS at most
    near = near.join(firsts, "_e", "left")
    lower = F.array_max(F.transform(F.filter("segs", lambda s: (s["_seg"] < F.col("_seg")) & (s["f"] < F.col("_seq"))), lambda s: s["_seg"]))
    upper = F.array_min(F.transform(F.filter("segs", lambda s: (s["_seg"] > F.col("_seg")) & (s["f"] < F.col("_seq"))), lambda s: s["_seg"]))
    near = near.withColumn("_lo", F.when(F.col("_before_at").isNull(), lower)).withColumn("_hi", F.when(F.col("_after_at").isNull(), upper)).drop("segs")
    asof = Window.partitionBy("_e", "_seg").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.max(F.when(F.col("q") == 0, F.struct("_at", "_seq"))).over(asof)
    oldest = F.min(F.when(F.col("q") == 0, F.col("_at"))).over(asof)
    known = near.select("_e", "_seg", "_at", "_seq", F.lit(0).alias("q"))
    ask = lambda to, q: near.filter(F.col(to).isNotNull()).select("_e", F.col(to).alias("_seg"), "_at", "_seq", F.lit(q).alias("q"))
    found = known.unionByName(ask("_lo", 1)).unionByName(ask("_hi", 2)).select("_e", "_seq", "q", newest.alias("nw"), oldest.alias("ol")).filter("q > 0")
    down = found.filter("q = 1").select("_e", "_seq", F.col("nw._at").alias("xb_at"), F.col("nw._seq").alias("xb_seq"))
    up = found.filter("q = 2").select("_e", "_seq", F.col("ol").alias("xa_at"))
    return (
        near.join(down, ["_e", "_seq"], "left").join(up, ["_e", "_seq"], "left")
        .withColumn("_before_at", F.coalesce("_before_at", "xb_at")).withColumn("_before_seq", F.coalesce("_before_seq", "xb_seq"))
        .withColumn("_after_at", F.coalesce("_after_at", "xa_at")).drop("xb_at", "xb_seq", "xa_at", "_lo", "_hi")
    )


def _ledger_of_hot(obs: DataFrame, hot: DataFrame, state: list[str]) -> DataFrame:
    """The ledger of entities cut into segments."""
    obs = obs.groupBy("_e", "_seq").agg(F.min(F.struct("_at", *state)).alias("r")).select("_e", "r._at", "_seq", *[F.col(f"r.{c}").alias(c) for c in state])
    seg = F.size(F.filter("cuts", lambda c: c < F.col("_at")))
    keys = obs.join(hot, "_e").select("_e", seg.alias("_seg"), "_at", "_seq")
    near = keys.repartition("_e", "_seg").sortWithinPartitions("_e", "_seg", "_at", "_seq").mapInArrow(_sweep, "_e long, _seg int, _at long, _seq long, _before_seq long, _before_at long, _after_at long, _same_seq long")
    near = _across(near)
    own = near.select("_e", F.col("_seq").alias("by"), F.col("_at").alias("vf"), F.col("_after_at").alias("vt"), F.col("_seq").alias("rf"))
    cut = near.filter("_before_seq is not null and _same_seq is null").select("_e", F.col("_before_seq").alias("by"), F.col("_before_at").alias("vf"), F.col("_at").alias("vt"), F.col("_seq").alias("rf"))
    closed = near.filter("_same_seq is not null").select("_e", F.col("_same_seq").alias("by"), F.lit(None).cast("long").alias("vf"), F.lit(None).cast("long").alias("vt"), F.col("_seq").alias("rf"))
    spans = own.unionByName(cut).unionByName(closed)
    spans = spans.withColumn("rt", F.lead("rf").over(Window.partitionBy("_e", "by").orderBy("rf"))).filter("vf is not null")
    rows = spans.join(obs.select("_e", F.col("_seq").alias("by"), *state), ["_e", "by"])
    # versions within a day, the days' edges through one small row each
    now = rows.filter("rt is null").select("_e", "by", F.col("vf").alias("_at"), F.struct(*state).alias("_s"), F.floor(F.col("vf") / 86_400_000_000).alias("_b"))
    now = now.withColumn("_p", F.lag(F.struct("_s")).over(Window.partitionBy("_e", "_b").orderBy("_at")))
    edges = now.groupBy("_e", "_b").agg(F.max_by("_s", "_at").alias("_l"))
    edges = edges.withColumn("_q", F.lag(F.struct(F.col("_l").alias("_s"))).over(Window.partitionBy("_e").orderBy("_b"))).drop("_l")
    same = F.col("_s").eqNullSafe(F.coalesce(F.col("_p"), F.col("_q"))["_s"])
    first = F.col("_p").isNull() & F.col("_q").isNull()
    starts = now.join(edges, ["_e", "_b"]).select("_e", "by", (first | ~same).alias("starts"))
    return rows.join(starts, ["_e", "by"], "left").select("_e", F.col("vf").alias("valid_from"), F.col("vt").alias("valid_to"), *state, F.col("by").alias("_by"), F.col("rf").alias("recorded_from"), F.col("rt").alias("recorded_to"), (F.coalesce("starts", F.lit(False)) & F.col("rt").isNull()).alias("starts_version"))


def ledger(observations: DataFrame, entity: str, at: str, seq: str, state: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The bitemporal ledger of ``observations``.

    entity: bigint key; at: microseconds of validity; seq: bigint order of recording (of an
    entity's rows with one seq that with the smallest instant counts); state: the columns kept as
    the state, without NaN. Rows whose entity, instant or seq is null are left out; an empty input
    gives an empty ledger; other columns are ignored, so their names can't clash.

    Result: entity, valid_from, valid_to (null: open), the state's columns, seq of the observation
    that stated it, recorded_from and recorded_to (seq; null: still held), starts_version: whether
    the row is held and its state differs from that of the instant before. All entities but hot
    ones need one exchange.
    """
    names = [f"s{i}" for i in range(len(state))]
    obs = observations.select(
        F.col(entity).cast("long").alias("_e"), F.col(at).cast("long").alias("_at"), F.col(seq).cast("long").alias("_seq"), *[F.col(c).alias(n) for c, n in zip(state, names)]
    ).dropna(subset=["_e", "_at", "_seq"])
    kinds = {f.name: f.dataType.simpleString() for f in obs.schema}
    hot = _hot(obs.select("_e", "_at"), hot_rows)
    most = obs if hot is None else obs.join(hot, "_e", "left_anti")
    schema = "_e long, valid_from long, valid_to long, " + "".join(f"{n} {kinds[n]}, " for n in names) + "_by long, recorded_from long, recorded_to long, starts_version boolean"
    rows = most.select("_e", F.lit(0).alias("_seg"), "_at", "_seq", *names).repartition("_e").sortWithinPartitions("_e", "_at", "_seq").mapInArrow(_sweep_whole, schema)
    if hot is not None:
        rows = rows.unionByName(_ledger_of_hot(obs.join(hot, "_e", "left_semi"), hot, names))
    return rows.withColumnsRenamed({"_e": entity, "_by": seq} | dict(zip(names, state)))


def versions(held: DataFrame, entity: str, state: list[str]) -> DataFrame:
    """The versions the ledger holds now, runs of equal states as one row each: entity,
    valid_from, the state. Null is a value of its own."""
    return held.filter("recorded_to is null and starts_version").select(entity, "valid_from", *state)
