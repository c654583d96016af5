import itertools

import numpy as np

from shelfspark.llm import listings

COLUMNS = "product_id long, supplier string, name string, sku string, brand string, series string, collection string, color string, wattage double, description string, dimensions string, width double, height double, diameter double, width_mm double, height_mm double, diameter_mm double, attributes map<string,string>, title string, group_id long"
SHOPS = [("a.example", "in mm", ["Norvexo", "Wexlund"]), ("b.example", "in cm", None)]


def rows(spark, items):
    full = [(i, shop, name, sku, None, None, None, None, None, None, dims, None, None, None, None, None, None, {}, "x", 0) for i, shop, name, sku, dims in items]
    return spark.createDataFrame(full, COLUMNS)


def shops(spark):
    return spark.createDataFrame(SHOPS, "host string, evidence string, brands array<string>")


def test_codes_colours_and_words():
    assert listings.code_of("LI-nv 9780098/01gr") == "NV9780098-01GR" and listings.code_of(None, "Norvexo NV978009801GR-SP") == "NV9780098-01GR-SP" and listings.code_of("12345", "") is None
    assert listings.colour_of(None, "weiß") == listings.colour_of("белая люстра") == "white" and listings.colour_of("") is None
    reader = listings.Reader(["Wexlund", "Quadrille Lux"])
    assert reader.series("Люстра Векслунд Лисопуга 60 Вт белая", [], None) == [listings._skeleton("Lisopuga")]
    assert reader.series("", [None, "Vuluzaso"], "Norvexo") == ["vuluzaso"]


def test_listings_of_one_product_meet(spark):
    items = [
        (1, "a.example", "Бра Norvexo Vuluzaso NV9780098-01GR 7 Вт серое 130 мм", "NV9780098-01GR", None), (2, "b.example", "gray Wall lamp Vuluzaso norvexo 7W free shipping", "nv978009801gr", "W 13 cm"), (3, "b.example", "Настенный светильник Вулузасо 13 см 7 Вт серый", None, None),
        (4, "a.example", "Бра Norvexo Vuluzaso NV9780098-02GR 9 Вт серое 130 мм", "NV9780098-02GR", None), (5, "a.example", "Запасной плафон для: бра Norvexo Vuluzaso NV9780098-01GR 7 Вт серое 130 мм", "NV9780098-01GR", None), (6, "a.example", "Бра Norvexo Vuluzaso NV9780098-01GR 7 Вт серое 130 мм", "NV9780098-01GR", None),
        (7, "a.example", "Бра Norvexo Vuluzaso 7 Вт белое 130 мм", None, None), (8, None, None, None, None), (9, "a.example", "", "", None), (10, "b.example", "слово " * 5000, None, None),
    ]
    grouped = listings.groups(rows(spark, items), shops(spark))
    got = {}
    for r in grouped.collect():
        got.setdefault(r.group_id, set()).add(r.product_id)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3, 6], [4], [5], [7], [8, 9], [10]] or sorted(map(sorted, got.values())) == [[1, 2, 3, 6], [4], [5], [7], [8], [9], [10]]
    pairs = {tuple(r) for r in listings.pairs_of(grouped).collect()}
    assert {p for p in pairs if max(p) < 8} == set(itertools.combinations((1, 2, 3, 6), 2))


def test_empty(spark):
    assert listings.groups(rows(spark, []), shops(spark)).count() == 0


def test_components_like_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(map(int, rng.integers(0, 60, 2)))) for _ in range(45)} | {(i, i + 1) for i in range(100, 130)}
    pairs = {p for p in pairs if p[0] != p[1]}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.root for r in listings.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_training_brings_pairs_together():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for code in range(40):
        own = rng.integers(0, listings.BUCKETS, 6)
        for _ in range(2):
            bags.append(np.concatenate([own, rng.integers(0, 200, 12)]).astype(np.int32))
            labels.append(str(code))
    hits = []
    for steps in (0, 60):
        v = listings._sums(bags, listings.train(bags, labels, steps=steps, batch=32))
        s = v @ v.T
        np.fill_diagonal(s, -2)
        hits.append(np.mean([labels[int(j)] == labels[i] for i, j in enumerate(s.argmax(1))]))
    assert hits[1] >= hits[0] and hits[1] > 0.9


def test_recall_of_the_index_at_two_sizes(spark):
    from shelfspark.llm.queries import p4_recall

    for sf, queries in (("sf0.01", 12), ("sf0.1", 120)):
        r = p4_recall(spark, f"/root/testdata/{sf}").first()
        assert r.queries == queries and r.recall >= 0.9


ENCODED = "rid long, vec binary, bytes binary, list int, cell int, asked array<int>, asks array<struct<cell:int,lists:array<int>>>, code_h long, spare boolean, size double, height double, watt double, colour string, series array<long>"


def encoded(spark, items, lists=None, probes=None, series=None):
    """items: id, similarity to the first axis, code, watt. All in one list, unless ``lists`` (of an
    id) and ``probes`` (the lists an id probes) say else; every list is a cell."""

    def row(rid, sim, code, watt):
        v = np.array([sim, (1 - sim**2) ** 0.5])
        own, probed = (lists or {}).get(rid, 0), (probes or {}).get(rid, [0])
        asks = [(x, [x]) for x in probed if x >= own]
        return rid, v.astype(np.float16).tobytes(), np.round(v * 127).astype(np.int8).tobytes(), own, own, probed, asks, code, False, 100.0, None, watt, "white", (series or {}).get(rid, [5])

    return spark.createDataFrame([row(*x) for x in items], ENCODED)


def linked(found):
    return sorted((r.a, r.b) for r in found.collect())


def test_similarity_and_mutual_probes_decide(spark):
    items = [(1, 1.0, None, 7.0), (2, 0.9, 2, 7.0), (3, 0.2, 3, 7.0)]
    assert linked(listings.links(encoded(spark, items))) == [(1, 2), (1, 3)]
    assert linked(listings.links(encoded(spark, items), 0.8)) == [(1, 2)]
    assert linked(listings.links(encoded(spark, items), 1.5)) == []
    lists = {1: 0, 2: 1, 3: 2}
    both = {1: [0, 1, 2], 2: [0, 1], 3: [0, 2]}
    assert linked(listings.links(encoded(spark, items, lists, both))) == [(1, 2), (1, 3)]
    assert linked(listings.links(encoded(spark, items, lists, both | {2: [1]}))) == [(1, 3)]
    assert linked(listings.links(encoded(spark, items, lists, both | {1: [0, 2]}))) == [(1, 3)]


def test_links_are_found_beyond_equal_codes_and_equal_values(spark):
    # words of the series that only overlap, and a listing that lacks the series
    rows = encoded(spark, [(1, 1.0, 1, 7.0), (2, 1.0, None, 7.0), (3, 0.97, None, 7.0)], series={1: [5], 2: [5, 6], 3: []})
    assert listings.same_values(rows).count() == 0 and linked(listings.links(rows, 0.9)) == [(1, 2)]
    found = listings.all_links(rows, 0.9)
    roots = listings.components(found.filter("sure").select("a", "b"))
    assert {r.id: r.root for r in listings.join_lacking(found.filter("not sure").select("a", "b"), roots).collect()} == {1: 1, 2: 1, 3: 1}
    assert listings.all_links(rows, 0.98).filter("not sure").count() == 0


def test_least_similarity_is_learnt_from_labelled_pairs():
    v = np.array([[1, 0]] * 60 + [[0.6, 0.8]], np.float32)
    assert listings.least_similarity(v, ["c"] * 61) < 0.7 and abs(listings.least_similarity(v[:60], ["c"] * 60) - 1 + listings.SLACK) < 1e-6
    assert listings.least_similarity(v[:9], ["c"] * 9) == -1.0 and listings.least_similarity(v, [None] * 61) == -1.0


def test_cells_in_parts_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = [(i, 1 - i / 1000, None if i % 3 else i // 9, float(i % 4)) for i in range(1, 90)]
    lists = {i: int(rng.integers(0, 3)) for i in range(1, 90)}
    rows = encoded(spark, items, lists, {i: [0, 1, 2] for i in lists})
    roots = lambda: {r.id: r.root for r in listings.components(listings.same_values(rows).unionByName(listings.links(rows))).collect()}
    want = roots()
    monkeypatch.setattr(listings, "CELL_ROWS", 7)
    assert roots() == want


def test_partner_behind_many_vetoed_variants_is_linked(spark):
    got = listings.links(encoded(spark, [(1, 1.0, None, 7.0), *[(i, 1.0, i, 9.0) for i in range(2, 80)], (90, 0.5, 90, 7.0)])).collect()
    assert {(r.a, r.b) for r in got if 1 in (r.a, r.b)} in ({(1, 90)}, {(1, 90), (90, 1)})


def test_no_link_is_left_out_however_many_agree(spark):
    rows = encoded(spark, [(i, 1 - i / 1000, 7 if i % 2 else None, 7.0) for i in range(1, 301)])
    roots = {r.root for r in listings.components(listings.same_values(rows).unionByName(listings.links(rows))).collect()}
    assert roots == {1}


def test_all_words_of_a_name_count():
    words = listings.Reader([]).series("Роскошный эксклюзивный премиальный шикарный изысканный элитный великолепный Вулузасо", [], None)
    assert listings._skeleton("Вулузасо") in words
    f = listings._columns(listings.pd.DataFrame({"series": [list(range(1, 12)), [11], [12]], "colour": ["white"] * 3, "code_h": [None] * 3, "spare": [False] * 3, "size": [1.0] * 3, "height": [1.0] * 3, "watt": [1.0] * 3}))
    assert listings._agree(f, np.array([0, 0]), f, np.array([1, 2])).tolist() == [True, False]


def test_missing_value_is_no_veto_where_one_product_is_left(spark):
    base = [(1, 1.0, 1, 7.0), (2, 1.0, 1, 7.0), (5, 1.0, None, None)]
    for more, want in (([], {1: 1, 2: 1, 5: 1}), ([(9, 1.0, 9, 9.0)], {1: 1, 2: 1})):
        rows = encoded(spark, base + more)
        found = listings.all_links(rows)
        roots = listings.components(listings.same_values(rows).unionByName(found.filter("sure").select("a", "b")))
        got = listings.join_lacking(found.filter("not sure").select("a", "b"), roots)
        assert {r.id: r.root for r in got.collect()} == want


def test_probes_are_checked_against_all_rows(spark):
    # half of the neighbours lie in the second nearest list, which one probe doesn't hold
    centres = np.eye(4, dtype=np.float32)
    index = listings.Index(np.zeros((1, 4), np.float32), centres, np.zeros(4, int), 1, 1.0, 1.0, -1.0)
    v = lambda a, b: np.array([a, b, 0, 0], np.float16)
    rows = [(i, v(0.8, 0.6).tobytes(), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "rid long, vec binary, list int").withColumn("cell", listings.F.lit(0))
    checked = listings.check_probes(df, index, queries=3, k=10)
    assert checked.probes == 2 and checked.nearest == 1.0
    got = {r.rid: (r.asked, [(a.cell, a.lists) for a in r.asks]) for r in listings.with_lists(df, checked).collect()}
    assert got[0] == ([0, 1], [(0, [0, 1])]) and got[5] == ([0, 1], [(0, [1])])
    assert listings.check_probes(df.limit(0), index).probes == 1
