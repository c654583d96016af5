import random

from pyspark.sql import functions as F

from shelfspark.functions import text, urls
from shelfspark.operators import evaluate, ranking, search, upsert, vectors


def test_text_and_url_functions(spark):
    df = spark.createDataFrame([("Бра «Ёлка» LED, бра 12 500,50 руб", "https://www.Shop.example/cat/lamp-AB123/?q=1#x", None)], "t string, u string, n string")
    r = df.select(text.tokens(F.col("t")).alias("tokens"), text.tokens(F.col("n")).alias("none"), text.first_number(F.col("t")).alias("number"), text.dimension_mm(F.lit("высота 12,5 см")).alias("mm"), urls.host(F.col("u")).alias("host"),
                  urls.canonical(F.col("u")).alias("canonical"), urls.sku(F.col("u")).alias("sku"), urls.category(F.col("u")).alias("category"), urls.host_suffixes(F.lit("a.b.c")).alias("suffixes"), text.clean_blank(F.lit("  ")).alias("blank")).first()
    assert r.tokens == ["бра", "ёлка", "led", "12", "500", "50", "руб"] and r.none == [] and r.number == 12500 and r.mm == 125
    assert (r.host, r.canonical, r.sku, r.category) == ("shop.example", "https://www.Shop.example/cat/lamp-AB123?q=1", "AB123", "cat")
    assert r.suffixes == ["a.b.c", "b.c", "c"] and r.blank is None


def test_upsert_keeps_and_overwrites(spark):
    rows = [("k", 1, "a", "x"), ("k", 2, None, None), ("k", 3, "c", ""), (None, 1, "n", None)]
    df = spark.createDataFrame(rows, "key string, seq long, over string, keep string")
    got = {r.key: r for r in upsert.upsert(df, ["key"], ["seq"], ["over"], ["keep"]).collect()}
    assert (got["k"].over, got["k"].keep, got[None].over) == ("c", "", "n")
    got = upsert.upsert(df.filter("seq < 3"), ["key"], ["seq"], ["over"], ["keep"], empty_counts=False).filter("key = 'k'").first()
    assert (got.over, got.keep) == (None, "x")
    assert upsert.latest(df, ["key"], ["seq"]).filter("key = 'k'").first().seq == 3


def test_quota_top_k_is_the_greedy_choice(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice("abc"), rng.randrange(6), i) for g in range(4) for i in range(rng.randrange(0, 40))]
    df = spark.createDataFrame(rows, "g long, s string, score long, id long")
    got = {(r.g, r.id) for r in ranking.quota_top_k(df, ["g"], "s", [F.col("score").desc(), F.col("s"), F.col("id")], 3, 7).collect()}
    want = set()
    for g in range(4):
        taken, per = 0, {}
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1], r[3])):
            if taken < 7 and per.get(r[1], 0) < 3:
                per[r[1]] = per.get(r[1], 0) + 1
                taken += 1
                want.add((g, r[3]))
    assert got == want


def test_even_sample(spark):
    for n in (1, 5, 7, 8, 29):
        for most in (0, 1, 2, 7, 10):
            got = [r.id for r in ranking.even_sample(spark.range(n).withColumn("g", F.lit(1)), ["g"], [F.col("id")], most).orderBy("id").collect()]
            want = [] if most <= 0 else [0] if most == 1 else list(range(n)) if n <= most else sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})
            assert got == want, (n, most)


def test_vector_search_and_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 1), (4, None, 1)], "id long, v array<float>, g long")
    got = [(r.query_id, r.id, r.rank_no) for r in vectors.search(df, df.filter("id = 1"), "id", "v", 2).orderBy("rank_no").collect()]
    assert got == [(1, 1, 1), (1, 2, 2)]
    assert vectors.search(df, df.filter("id > 9"), "id", "v", 2).count() == 0
    best = vectors.grouped_search(df.withColumn("p", F.col("id") % 2), df.filter("v is not null"), "g", "v", "p", "id", 5).filter("g = 0").orderBy("rank_no").collect()
    assert [(r.p, r.best_image) for r in best] == [(0, 2), (1, 1)]


def test_many_query_vectors_are_asked_in_passes(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, i // 3, [rng.random() for _ in range(4)], i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, p long, v array<double>, g long")
    run = lambda **how: sorted(map(tuple, vectors.grouped_search(df, df.filter("id < 30"), "g", "v", "p", "id", 4, **how).collect()))
    text = df.filter("id < 7").select("g", "v")
    want = [run(), run(mode="mean"), run(text=text)]
    assert len(want[0]) == 28
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 9)
    assert [run(), run(mode="mean"), run(text=text)] == want


def test_bm25_needs_all_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "бра белое стекло"), (2, "бра чёрное"), (3, None)], "id long, t string")
    asked = spark.createDataFrame([("q", "Бра стекло"), ("none", "")], "q string, w string")
    assert [(r.q, r.id, r.rank_no) for r in search.bm25(docs, "id", "t", asked, "q", "w", 5).collect()] == [("q", 1, 1)]
    first = search.bm25(docs, "id", "t", asked, "q", "w", 2, first_if_empty=True).filter("q = 'none'").orderBy("rank_no").collect()
    assert [(r.id, r.rank_no, r.score) for r in first] == [(1, 1, None), (2, 2, None)]
    monkeypatch.setattr(search, "MOST_WORDS", 1)
    assert [(r.q, r.id, r.rank_no) for r in search.bm25(docs, "id", "t", asked, "q", "w", 5).collect()] == [("q", 1, 1)]


def test_metrics(spark):
    df = spark.createDataFrame([(1,), (4,), (None,), (50,)], "r int")
    r = evaluate.metric_summary(df, "r", []).first()
    assert (r.targets, r.found, r.recall_at_1, r.recall_at_5, r.recall_at_50, r.median_rank) == (4, 3, 0.25, 0.5, 0.75, 4.0)
    assert evaluate.stage_recall(df.filter("r > 99"), [], {"a": F.lit(True)}).first().a_recall is None


def test_cache_gives_sound_vectors_of_the_same_model_and_version(spark):
    from shelfspark.operators.vectors import cached

    kind = "model string, version string, hash string, vector array<double>"
    rows = [("m", "v2", "good", [1.0, 2.0]), ("m", "v1", "old", [1.0, 2.0]), ("n", "v2", "other", [1.0, 2.0]), ("m", "v2", "nan", [1.0, float("nan")]), ("m", "v2", "inf", [float("-inf"), 1.0]), ("m", "v2", "hole", [1.0, None]), ("m", "v2", "short", [1.0]), ("m", "v2", "null", None), ("m", "v2", "twice", [float("nan"), 1.0]), ("m", "v2", "twice", [3.0, 4.0])]
    names = ["good", "old", "other", "nan", "inf", "hole", "short", "null", "twice", "missing"]
    wanted = spark.createDataFrame([("m", "v2", h) for h in names * 2], "model string, version string, hash string")
    got = cached(wanted, spark.createDataFrame(rows, kind), 2).collect()
    assert len(got) == len(names) and {r.hash: r.vector for r in got if r.vector} == {"good": [1.0, 2.0], "twice": [3.0, 4.0]}
