import numpy as np
from pyspark.sql import functions as F

from shelfspark.functions import taxonomy, text, urls
from shelfspark.operators import index

CACHE = "model string, version string, hash string, vector array<double>"


def test_index_is_built_by_hash_and_mends_its_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def encode(images):
        calls.add(len(images))
        return np.array([[3.0 * len(x), 4.0 * len(x)] for x in images])

    rows = [(1, ["a", "b", None, "c", "d"], "z"), (2, ["a"], None), (3, [], "p"), (4, None, "p"), (5, None, None), (6, [None], None)]
    products = spark.createDataFrame(rows, "id long, images array<string>, main string")
    images = index.image_rows(products, "id", F.col("images"), F.col("main"), 3)
    assert sorted(map(tuple, images.collect())) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a"), (3, 1, "p"), (4, 1, "p")]
    assert index.image_rows(products, "id", F.col("images"), F.col("main"), 9).count() == 6 and index.image_rows(products, "id", F.col("images"), F.col("main"), 0).count() == 4
    h = lambda x: spark.range(1).select(F.sha2(F.lit(x), 256)).first()[0]
    cache = spark.createDataFrame([("m", "2", h("a"), [1.0, 0.0]), ("m", "1", h("b"), [1.0, 0.0]), ("m", "2", h("c"), [float("nan"), 0.0]), ("m", "2", h("p"), [1.0])], CACHE)
    got = index.build(images, cache, encode, "m", "2", 2, str(tmp_path / "one"))
    held = {(r.id, r.image): (r.vector, r.from_cache) for r in got.collect()}
    assert held[1, "a"] == held[2, "a"] == ([1.0, 0.0], True) and calls.value == 3  # b, c and p, each once
    assert all(np.allclose(held[k][0], [0.6, 0.8]) and not held[k][1] for k in ((1, "b"), (1, "c"), (3, "p"), (4, "p")))
    again = index.build(images, index.load_cache(spark, str(tmp_path / "one")), encode, "m", "2", 2, str(tmp_path / "two"))
    assert again.count() == 6 and calls.value == 3 and again.filter("not from_cache").count() == 0
    assert index.load(spark, str(tmp_path / "one")).count() == 6
    assert index.build(images.limit(0), cache, encode, "m", "2", 2, str(tmp_path / "none")).count() == 0


def test_controlled_family(spark):
    rows = [
        ("Бра настенное Bradford", "bra-dekorativnyie", "https://e.example/bra", "decorative_wall"), ("Подвесной светильник", "podvesnye-svetilniki", "https://e.example/podvesnoy-svetilnik", "pendant_single"), ("Трековый светильник 24°", "potolochnie", "https://e.example/track-light", "track_spot"),
        ("Подвесная люстра", "lustri", "https://e.example/lyustra", "unknown"), ("Подвесной светильник", "lustri", "https://e.example/pendant", "pendant_single"), ("Коннектор", "tracks", "https://e.example/connector", "accessory"), ("Светильник", "spoty_podvesnye", "https://e.example/spoty_podvesnye/x", "pendant_single"),
        ("Трековый светильник круглый", None, None, "unknown"), ("Спот чёрный", None, None, "spot"), (None, None, None, "unknown"),
    ]
    df = spark.createDataFrame(rows, "t string, c string, u string, want string")
    assert [(r.got, r.want) for r in df.select(taxonomy.controlled(F.col("t"), F.col("c"), F.col("u")).alias("got"), "want").collect() if r.got != r.want] == []


def test_offer_price_and_url_selectors(spark):
    got = spark.createDataFrame([("1 249,50 руб",), ("от 12 500",), ("нет",), (None,)], "t string").select(text.offer_price(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [1249.5, 12500.0, None, None]
    rules = spark.createDataFrame([("a.example", "^/p/"), ("example", "[0-9]$")], "suffix string, pattern string")
    rows = spark.createDataFrame([("https://www.a.example/p/x",), ("https://a.example/q/1",), ("https://b.a.example/p/x",), ("https://c.example/q/1",), ("https://other/q/1",), (None,), (None,)], "u string")
    assert sorted((r.u or "", r.selected) for r in urls.selected(rows, "u", rules).collect()) == sorted([("https://www.a.example/p/x", True), ("https://a.example/q/1", False), ("https://b.a.example/p/x", True), ("https://c.example/q/1", True), ("https://other/q/1", False), ("", False), ("", False)])
