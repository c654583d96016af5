import random

import pytest

from shelfspark.functions.times import instant_micros
from shelfspark.operators.history import ledger, versions
from pyspark.sql import functions as F

SCHEMA = "product_id long, at long, load_seq long, status string, price double, valid_from string, by string"


def brute(rows):
    """The ledger kept the slow way: one observation after the other."""
    out = []
    for e in sorted({r[0] for r in rows}):
        live, done = [], []
        for _, at, seq, status, price in sorted((r for r in rows if r[0] == e), key=lambda r: r[2]):
            row = next((x for x in live if x["vf"] == at), None)
            if row is None:
                row = next((x for x in live if x["vf"] < at and (x["vt"] is None or at < x["vt"])), None)
                later = [x["vf"] for x in live if x["vf"] > at]
                end = min(later) if later else None
                if row is not None:
                    live.remove(row)
                    done.append(row | {"rt": seq})
                    live.append(row | {"vt": at, "rf": seq})
            else:
                end = row["vt"]
                live.remove(row)
                done.append(row | {"rt": seq})
            live.append({"e": e, "vf": at, "vt": end, "s": status, "p": price, "by": seq, "rf": seq, "rt": None})
        out += done + live
    return sorted((x["e"], x["vf"], x["vt"] or -1, x["s"], x["p"], x["by"], x["rf"], x["rt"] or -1) for x in out)


def made(spark, rows, hot):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = ledger(df, "product_id", "at", "load_seq", ["status", "price"], hot_rows=hot).collect()
    return sorted((r[0], r[1], r[2] if r[2] is not None else -1, r[3], r[4], r[5], r[6], r[7] if r[7] is not None else -1) for r in got)


@pytest.mark.parametrize("hot", [200_000, 5])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ledger_is_what_one_by_one_gives(spark, hot, seed):
    rng = random.Random(seed)
    rows, seq = [], 0
    for e in (1, 2, 3):
        for _ in range(rng.choice([1, 12, 40])):
            seq += 1
            rows.append((e, rng.randrange(1, 25) * 1_000_000, seq, rng.choice("ab"), float(rng.randrange(3))))
    assert made(spark, rows, hot) == brute(rows)


def test_ledger_in_order_and_backwards_with_segments(spark):
    forward = [(1, i * 10, i, "a", float(i)) for i in range(1, 60)]
    backward = [(2, 1000 - i * 10, 100 + i, "b", float(i)) for i in range(1, 60)]
    assert made(spark, forward + backward, 7) == brute(forward + backward)


def test_repeated_rows_count_once_and_nulls_are_left_out(spark):
    rows = [(1, 10, 1, "a", 1.0)] * 3 + [(1, None, 2, "b", 1.0), (None, 5, 3, "c", 1.0), (1, 5, None, "c", 1.0)]
    assert made(spark, rows, 100) == [(1, 10, -1, "a", 1.0, 1, 1, -1)]
    assert made(spark, [], 100) == []


def test_versions_join_equal_states_and_null_is_a_value(spark):
    day = 86_400_000_000
    rows = [(1, 0, 1, "a", 1.0), (1, 5, 2, "a", 1.0), (1, day, 3, "a", 1.0), (1, 2 * day, 4, "a", None), (1, 3 * day, 5, "a", None), (1, 4 * day, 6, "b", None), (2, 7, 7, None, None), (2, 9, 8, None, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = versions(ledger(df, "product_id", "at", "load_seq", ["status", "price"]), "product_id", ["status", "price"])
    assert sorted((r.product_id, r.valid_from) for r in got.collect()) == [(1, 0), (1, 2 * day), (1, 4 * day), (2, 7)]


def test_instants(spark):
    texts = ["2025-01-01T00:00:00Z", "2025-01-01 00:00:00", "2025-01-01T05:30:00+05:30", "1735689600", " 1735689600.5 ", "2025-01-01", "soon", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(instant_micros(F.col("t"))).collect()]
    assert got[:4] == [1735689600000000] * 4 and got[4] == 1735689600500000 and got[5] == 1735689600000000 and got[6:] == [None] * 3
