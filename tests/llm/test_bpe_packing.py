import random

import pytest
from tokenizers import Tokenizer

from shelfspark.llm import bpe, packing

TEXTS = [None, "", " ", "Hello  world\n\n\tx", "Светильник 12,5 см – Größe № 5", "日本語🙂👩‍🔧", "a" * 3000, "'s don't I'LL", "<|endoftext|>", "퟿\x00�", "é́́", "1234567890 ½"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks())


def test_same_ids_as_the_public_library(encoder):
    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    library.encode_special_tokens = True
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("ab éя中🙂 \n'0") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert [encoder.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(encoder):
    for t in TEXTS:
        assert encoder.decode(encoder.encode(t)) == (t or "")


def test_tables(spark, encoder):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "again", "x"), (None, "b", "x")], "doc_id long, text string, ids string")
    got = bpe.encode_texts(df, "doc_id", "text")
    assert got.count() == len(TEXTS) + 2 and got.filter("doc_id = 1").first().ids == []
    assert dict(got.filter("doc_id < 2 and size(ids) = 0").collect()) == {0: [], 1: []}
    assert bpe.count_tokens(df, "doc_id", "text").filter("doc_id = 6").first().n_tokens == len(encoder.encode("a" * 3000))
    back = bpe.decode_ids(got.dropDuplicates(["doc_id"]), "doc_id", "ids").filter("doc_id = 4").first()
    assert back.text == TEXTS[4]
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def check(rows, sizes, capacity):
    fill, pieces = {}, {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.length
        pieces.setdefault(r.id, []).append((r.piece_no, r.start, r.length))
    assert max(fill.values()) <= capacity
    for key, size in sizes.items():
        p = sorted(pieces[key])
        assert sum(x[2] for x in p) == size and (size > capacity or len(p) == 1)
        assert [x[1] for x in p] == [sum(y[2] for y in p[:i]) for i in range(len(p))]
    return fill


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 1, 5, 40, 99, 100, 101, 250, rng.randrange(1, 100)]) for i in range(2000)}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()], "id long, n long, container string").repartition(4)
    fill = check(packing.pack(df, "id", "n", capacity=100).collect(), sizes, 100)
    assert sum(fill.values()) / (100 * sum(v > 0 for v in fill.values())) > 0.97


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None), (2, -5), (3, 100), (3, 100)], "id long, n long")
    rows = packing.pack(df, "id", "n", capacity=100).collect()
    assert len(rows) == 4 and sorted(r.length for r in rows) == [0, 0, 100, 100]
    assert packing.pack(df.limit(0), "id", "n").count() == 0


def test_fullest_closes_first():
    fit = packing.BestFit(10, 2)
    assert [fit.put(n) for n in (4, 7, 8, 6, 2, 3)] == [0, 1, 2, 0, 2, 3]  # 1 (3 free) stays open till 2 opens
