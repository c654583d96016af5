from pyspark.sql import functions as F

import math
import random

from shelfspark.llm import topn

SCHEMA = "g string, s double, i long, t long, rank_no int, extra string"


def brute(rows, n):
    out = []
    for g in sorted({r[0] for r in rows if r[0] is not None}):
        seen, best = set(), []
        for r in sorted({r[:4] for r in rows if r[0] == g and r[1] is not None and not math.isnan(r[1]) and r[3] is not None}, key=lambda r: (-r[1], r[3])):
            if r[2] not in seen and len(best) < n:
                seen.add(r[2])
                best.append(r)
        out += [(g, k, r[3], r[2], r[1]) for k, r in enumerate(best, 1)]
    return sorted(out, key=str)


def test_like_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), 0.1, 0.2, 0.2, 0.3]), rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]), t, 9, "x") for t in range(300)]
    rows += rows[:20] + [("lonely", 0.5, 1, 1000, 0, ""), ("none", None, 1, 1001, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, topn.top_n(df, "g", "s", "i", "t", 5).collect()), key=str)
    assert got == brute(rows, 5)


def test_small_buffers_change_nothing(spark, monkeypatch):
    rows = [("hot", float(k % 97), k % 50, k, 0, "") for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(topn, "BUFFER_ROWS", 100)
    assert sorted(map(tuple, topn.top_n(df, "g", "s", "i", "t", 5).collect()), key=str) == brute(rows, 5)


def test_empty(spark):
    assert topn.top_n(spark.createDataFrame([], SCHEMA), "g", "s", "i", "t").count() == 0


def test_rows_under_the_bound_dont_move(spark, monkeypatch):
    # nine tenths of the rows are one group's: what is ranked is n rows, whichever way bounds travel
    df = spark.range(200_000, numPartitions=8).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id"))).alias("g"), F.col("id").alias("s"), F.col("id").alias("i"), F.col("id").alias("t"))
    want = None
    for most in (200_000, 0):
        monkeypatch.setattr(topn, "SENT_BOUNDS", most)
        got = topn.top_n(df, "g", "s", "i", "t", 5)
        rows = got.filter("g = 'hot'").orderBy("rank_no").collect()
        assert [r.t for r in rows] == [199_999, 199_998, 199_997, 199_996, 199_995]
        want = want or got.count()
        assert got.count() == want == 20_005
    bounds = df.select(F.col("g").alias("_g"), F.col("s").cast("double").alias("_s"), F.col("i").alias("_i"), F.lit(False).alias("_in")).mapInPandas(topn._bounds(5), "_g string, _b double").groupBy("_g").agg(F.max("_b")).collect()
    assert [tuple(r) for r in bounds] == [("hot", 199_995.0)]
