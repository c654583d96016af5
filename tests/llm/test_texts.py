import itertools

import numpy as np
import pytest

from shelfspark.llm import boilerplate, mojibake, unify, vocabulary

CLEAN = ["Рассеиватель снимается без инструмента, его легко помыть под краном.", "Подойдёт для комнаты площадью 12 м², если дополнить торшером — и всё.", "Größe der Grundplatte: 90 mm, das Gehäuse bleibt kühl.", "Proteção IP54, própria também para áreas úmidas.", "A café’s table, 30 °C and ±2 mm.", "ВНИМАНИЕ: НЕ УСТАНАВЛИВАТЬ БЕЗ ЗАЗЕМЛЕНИЯ.", "ATENÇÃO: NÃO INSTALAR.", "Зона «В», ряд В. Сёстры, рёбра и Крепёж; 5 € и № 7", "🙂 照明ライト １２"]


@pytest.fixture(scope="module")
def restorer():
    counts = np.zeros(mojibake.K**3, np.int64)
    for word in itertools.chain.from_iterable(t.split() for t in CLEAN):
        c = mojibake.classes(word)
        np.add.at(counts, c[:-2] * mojibake.K**2 + c[1:-1] * mojibake.K + c[2:], 200)
    return mojibake.Restorer(counts)


@pytest.mark.parametrize("text", CLEAN)
def test_proper_text_is_left_alone(restorer, text):
    assert restorer.text(text) == (text, 0)


@pytest.mark.parametrize("wrong", ["cp1251", "latin_1", "cp1252", "cp437"])
def test_misread_utf8_comes_back(restorer, wrong):
    for text in CLEAN[:5]:
        bad = "".join(mojibake._misread(c, wrong) if ord(c) > 127 else c for c in text)
        fixed, n = restorer.text(bad)
        assert fixed == text and n > 0, bad


@pytest.mark.parametrize(("wrong", "right"), [("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("latin_1", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp852", "cp1251"), ("mac_iceland", "iso8859_5"), ("cp1257", "cp855")])
def test_misread_bytes_come_back(restorer, wrong, right):
    bad = "".join(mojibake._DECODE[wrong][b] for b in CLEAN[0].encode(right))
    fixed, n = restorer.text(bad)
    assert n >= 1 and fixed == CLEAN[0]


def test_only_the_passage_is_touched(restorer):
    bad = "Рассеиватель снимается " + "без инструмента".encode().decode("cp1251", "replace").replace("�", "\x98") + ", его легко помыть"
    fixed, n = restorer.text(bad)
    assert n == 2 and fixed == "Рассеиватель снимается без инструмента, его легко помыть"
    assert restorer.text("ðŸ’¡") == ("💡", 1)
    assert restorer.text("Prote��o")[1] == 1 and restorer.text(None) == (None, 0) and restorer.text("") == ("", 0)


@pytest.mark.parametrize("wrong", ["cp1251", "koi8_r", "cp866"])
def test_words_with_one_or_two_foreign_letters_come_back(restorer, wrong):
    bad = "".join(mojibake._DECODE[wrong][b] for b in CLEAN[2].encode("cp1252"))
    fixed, n = restorer.text(bad)
    assert fixed == CLEAN[2] and n == 3


@pytest.mark.parametrize("wrong", mojibake.UTF8_AS)
def test_utf8_misread_in_any_encoding_comes_back(restorer, wrong):
    words = right = 0
    for text in CLEAN[:5]:
        bad = "".join(mojibake._misread(c, wrong) if ord(c) > 127 else c for c in text)
        fixed, n = restorer.text(bad)
        assert n > 0, bad
        for a, b, c in zip(text.split(" "), bad.split(" "), fixed.split(" ")):
            words, right = words + (a != b), right + (a != b and a == c)
    assert right >= 0.9 * words, (right, words)


def corpus_texts(sf="sf0.01"):
    import pandas as pd

    d = pd.read_parquet(f"/root/testdata/{sf}/documents.parquet", columns=["text", "lang"])
    return d[d["text"].notna()]


@pytest.fixture(scope="module")
def trained():
    counts = np.zeros(mojibake.K**3, np.int64)
    for t in corpus_texts()["text"]:
        for w in t.split():
            c = mojibake.classes(w)
            np.add.at(counts, c[:-2] * mojibake.K**2 + c[1:-1] * mojibake.K + c[2:], 1)
    return mojibake.Restorer(counts)


def test_round_trips_of_all_pairs(trained):
    # texts of the corpus, garbled by every pair that has their letters: found, and words regained
    d = corpus_texts()
    proper = {lang: [t for t in d[(d["lang"] == lang) & d["text"].str.len().between(150, 800)]["text"] if not t.isascii() and trained.text(t)[1] == 0][:2] for lang in ("ru", "de", "fr", "pt")}
    found = texts = right = words = 0
    for (read, written), of in zip(mojibake.BYTE_PAIRS, mojibake._MAPS):
        meant, into = set(of.values()), mojibake._ENCODE[written]
        for lang, letters in zip(proper, mojibake.ALPHABETS):
            for t in proper[lang] if all(c in meant for c in letters) else ():
                bad = "".join(mojibake._DECODE[read][into[c]] if c in into else c for c in t)
                if bad == t:
                    continue
                fixed, n = trained.text(bad)
                found, texts = found + (n > 0), texts + 1
                for a, b, c in zip(t.split(" "), bad.split(" "), fixed.split(" ")):
                    words, right = words + (a != b), right + (a != b and a == c)
    assert texts > 1000 and found >= 0.96 * texts and right >= 0.85 * words, (found, texts, right, words)


def test_a_text_is_judged_alone_as_in_the_corpus(trained):
    alone = mojibake.Restorer(np.zeros(mojibake.K**3, np.int64))
    texts = corpus_texts()["text"].tolist()
    assert sum((trained.text(t)[1] > 0) != (alone.text(t)[1] > 0) for t in texts) <= len(texts) // 500


def test_restore_table(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CLEAN * 3)] + [(100, "Größe".encode().decode("cp1252")[:0] + "GrÃ¶Ã\x9fe", "x"), (101, None, ""), (102, "", "")], "doc_id long, text string, restored string")
    got = mojibake.restore(df, "doc_id", "text").filter("n_garbled > 0").collect()
    assert [(r.doc_id, r.restored) for r in got] == [(100, "Größe")]
    assert mojibake.restore(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize(
    ("value", "code", "form"),
    [
        ("ＷＸ６９９", True, "WX699"), ("ZR4735844-04СU", True, "ZR4735844-04CU"), ("ЖЛ4603181‑04", True, "ЖЛ4603181-04"), ("LI-ЖЛ1-SР", True, "LI-ЖЛ1-SP"), ("Sillаvеntо", False, "Sillavento"), ("дeрево", False, "дерево"), ("трек­овый", False, "трековый"),
        ("серый", False, "серый"), ("20 W", False, "20 W"), ("6𝟎0", False, "600"), ("Ζinaviba", False, "Zinaviba"), ("№ 5 м² ½", False, "№ 5 м² ½"), ("9ВТ", False, "9ВТ"), ("с гарантией", False, "с гарантией"), ("", False, ""), ("​", True, ""), ("ВК", True, "BK"), ("ᎠEКO", False, "DEKO"), ("Lanӏa", False, "Lanla"),
    ],
)
def test_forms(value, code, form):
    assert unify.unify(value, code) == form


def test_what_counts_as_a_difference(spark):
    assert not unify.differs("Бра  ЛЮКС ", False) and unify.differs("ﬀ", False) and unify.differs("a b", False)
    df = spark.createDataFrame([(1, "x" * 20_000, "ТVN1"), (2, None, None), (2, None, None)], "product_id long, name string, sku string")
    got = unify.unify_fields(df, "product_id", {"sku": True, "name": False}).filter("changed").collect()
    assert [(r.product_id, r.field_name, r.unified, r.compared) for r in got] == [(1, "sku", "TVN1", "tvn1")]
    assert unify.unify_fields(df.limit(0), "product_id", {"name": False}).count() == 0


REFERENCE = [("category", "spot", "Споты", "Spotlights"), ("category", "track_spot", "Трековые светильники", "Track lights"), ("category", "accessory", "Аксессуары и запчасти", "Accessories"), ("availability", "in_stock", "В наличии", "In stock"), ("availability", "out_of_stock", "Нет в наличии", "Out of stock"), ("availability", "unknown", "Нет данных", "Unknown")]


@pytest.mark.parametrize(
    ("value", "path", "code"),
    [
        ("Каталог / Свет / Споты", True, "spot"), ("Spotlgihts!", True, "spot"), ("trck spotlight", True, "track_spot"), ("светильники Трековые", True, "track_spot"), ("Трековые свети.", True, "track_spot"), ("Trekovye svetilniki", True, "track_spot"), ("Ковры и текстиль", True, "none"), ("-", True, "none"),
        ("В налчиии", False, "in_stock"), ("schema:OutOfStock", False, "out_of_stock"), ("nicht auf Lager", False, "out_of_stock"), ("0 шт. на складе", False, "out_of_stock"), ("Остаток 12 шт.", False, "in_stock"), ("Корзина (2)\nнет на сладе\nВойти", False, "out_of_stock"), ("данных нет", False, "unknown"), ("null", False, "none"), ("", False, "none"), ("\n \n", False, "none"),
    ],
)
def test_vocabulary(spark, value, path, code):
    ref = spark.createDataFrame(REFERENCE, "list_name string, ref_code string, label_ru string, label_en string")
    if not hasattr(test_vocabulary, "names"):
        test_vocabulary.names = vocabulary._names(ref, None)
    assert vocabulary.Matcher(test_vocabulary.names["category" if path else "availability"]).match(value, path) == code


def test_vocabulary_tables(spark):
    ref = spark.createDataFrame(REFERENCE, "list_name string, ref_code string, label_ru string, label_en string")
    df = spark.createDataFrame([(1, None, "Корзина (2)\nIn stock"), (2, "Споты", "x\ny"), (2, "Споты", None)], "product_id long, category string, ref_code string")
    got = vocabulary.map_values(df, "product_id", {"category": ("category", True)}, ref).collect()
    assert [tuple(r) for r in got] == [(2, "category", "spot")] * 2
    assert vocabulary.map_values(df.limit(0), "product_id", {"category": ("category", True)}, ref.limit(0)).count() == 0


def test_suffix_array_like_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 60, 61):
        tokens = rng.integers(0, 3, n)
        for depth in (None, 16):
            sa = boilerplate.Suffixes(tokens, depth)
            want = sorted(range(n), key=lambda i: tuple(tokens[i : i + (depth or n)]))
            assert [tuple(tokens[i : i + (depth or n)]) for i in sa.order] == [tuple(tokens[i : i + (depth or n)]) for i in want]
        starts = rng.integers(0, n, 80)
        lengths = np.minimum(rng.integers(1, 16, 80), n - starts)
        runs = [tuple(tokens[s : s + m]) for s, m in zip(starts, lengths)]
        got = boilerplate.Suffixes(tokens, 16).same(starts, lengths)
        assert all((got[i] == got[j]) == (runs[i] == runs[j]) for i in range(80) for j in range(80))


def test_repeats_count_pages_texts_and_middles():
    x = boilerplate.read(["Menu\nA b c.\nx 1", "menu\nq: A b c. z", "Menu\nx 22", "x 4", ""])
    c = boilerplate.count(x)
    assert x.page.tolist() == [0, 0, 0, 1, 1, 2, 2, 3, 4] and x.no.tolist() == [1, 2, 3, 1, 2, 1, 2, 1, 1]
    assert c.whole.tolist() == [3, 1, 3, 3, 1, 3, 3, 3, 1] and c.alone.tolist() == [0, 0, 1, 0, 0, 0, 1, 1, 1]
    assert c.free.tolist()[1] == 1 and sum(c.free) == 1
    assert len(boilerplate.count(boilerplate.read([])).lead) == 0


def test_boilerplate_table(spark):
    menu, foot = "Главная | Каталог | Контакты", "© 2019 Shop. Все права защищены"
    text = lambda i: f"{menu}\nЛампа светит {'очень ' * i}ровно вечером.\nМатериал: {'стекло' if i % 2 else 'бук'}\nБренды\n{foot}"
    rows = [(i, "h", text(i), 0) for i in range(6)] + [(6, None, "Одна строка", 0), (7, "h", None, 0), (8, "h", "", 0), (9, "h2", "\n" + "слово " * 20_000 + "конец.", 0)]
    got = boilerplate.boilerplate_lines(spark.createDataFrame(rows, "product_id long, supplier string, description string, line_no int"), "product_id", "supplier", "description")
    assert sorted(map(tuple, got.collect())) == [(i, n) for i in range(6) for n in (1, 4, 5)] + [(9, 1)]
    assert boilerplate.boilerplate_lines(spark.createDataFrame([], "product_id long, supplier string, description string"), "product_id", "supplier", "description").count() == 0


def found_lines(spark, texts, host="h"):
    df = spark.createDataFrame([(i, host, t) for i, t in enumerate(texts)], "product_id long, supplier string, description string")
    return sorted(map(tuple, boilerplate.boilerplate_lines(df, "product_id", "supplier", "description").collect()))


def test_repeats_decide_over_looks(spark):
    # unique lines stay whatever they look like; a prose template on 5 of 300 pages goes
    unique = [f"Яркость «{'абвгдежзик'[i % 10] * (i // 10 + 2)}» в {'клмнопрсту'[i % 10] * (i // 10 + 2)}!" for i in range(300)]
    texts = [f"Лампа {'деж'[i % 3] * (i + 2)} светит ровно.\n{unique[i]}" + ("\nМы отвечаем на письма каждый будний день." if i < 5 else "") for i in range(300)]
    texts[0] += "\nCRI: 90"
    assert found_lines(spark, texts) == [(i, 3) for i in range(5)]


def test_counts_hold_for_the_whole_host(spark, monkeypatch):
    # the sentence stands inside another line on one page only, in one of many shards
    monkeypatch.setattr(boilerplate, "SHARD_CHARS", 300)
    line, shop = "Провод убирается в чашу светильника.", "Мы отвечаем на письма каждый будний день."
    texts = [f"{'абвгд'[i % 5] * (i + 3)} светит очень ровно.\n{line}\n{shop}" for i in range(40)] + ["Рама лёгкая.\nКорпус тёплый. " + line]
    assert found_lines(spark, texts) == [(i, 3) for i in range(40)]


def test_long_template_lines_go(spark):
    words = lambda n: " ".join("".join("абвгдежзик"[int(d)] for d in f"{i:03d}") for i in range(n))
    texts = [f"Лампа {'деж'[i % 3] * (i + 2)} светит ровно.\nДоставка {words(200)} бесплатно." for i in range(6)]
    assert found_lines(spark, texts) == [(i, 2) for i in range(6)]


def test_without_repeats_nothing_goes(spark, monkeypatch):
    texts = ["Главная | Каталог\nЛампа светит ровно.\n© 2019 Shop"] * 6
    assert found_lines(spark, texts) == [(i, n) for i in range(6) for n in (1, 2, 3)]
    none = boilerplate.count
    monkeypatch.setattr(boilerplate, "count", lambda x: boilerplate.Counts(*[np.zeros_like(c) for c in none(x)]))
    assert found_lines(spark, texts) == []


def test_a_menu_in_unknown_letters_goes_and_shards_change_nothing(spark, monkeypatch):
    menu = ["ქართული", "ᎠᎡᎢ ᎣᎤ", "한국어 메뉴 / 홈"]
    rows = lambda i: [*menu, f"{'абвгд'[i % 5] * (i + 3)} светит очень ровно.", "Цвет: " + ("белый", "чёрный", "хром")[i % 3], f"Вес {i} кг, нужна закладная. Свет: тёплый."][i % 2 :]
    texts = ["\n".join(rows(i)) for i in range(40)] + ["ქართული", "Рама лёгкая: вес 4 кг, нужна закладная.\nx"]
    want = [(i, n) for i in range(40) for n in range(1, 4 - i % 2)]
    assert found_lines(spark, texts) == want
    monkeypatch.setattr(boilerplate, "SHARD_CHARS", 300)
    assert found_lines(spark, texts) == want


@pytest.mark.parametrize("shard", [8_000_000, 100])
def test_the_line_that_states(spark, monkeypatch, shard):
    monkeypatch.setattr(boilerplate, "SHARD_CHARS", shard)
    ref = spark.createDataFrame(REFERENCE, "list_name string, ref_code string, label_ru string, label_en string")
    texts = ["Zzz qq", "Zzz qq\nMenu", "Menu\nBasket (2)\nZzz qq", "Menu\nBasket (7)\n\nin stokc", None, "", "Menu\nMenu\nBasket (1)", "Menu\nother", "In stock", *["Menu\nBasket (3)\nZzz qq"] * 5]
    df = spark.createDataFrame([(i, "h", t) for i, t in enumerate(texts)], "product_id long, h string, t string")
    got = boilerplate.other_lines(df, "product_id", "h", "t", vocabulary.statements(ref, "availability"))
    found = sorted(map(tuple, got.collect()))
    assert found == [(1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (6, 1), (6, 2), (6, 3), (7, 1), *[(i, n) for i in range(9, 14) for n in (1, 2)]]
    assert boilerplate.other_lines(df.limit(0), "product_id", "h", "t", vocabulary.statements(ref, "availability")).count() == 0


def test_all_words_of_a_value_count(spark):
    ref = spark.createDataFrame([("category", "x", " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)), None)], "list_name string, ref_code string, label_ru string, label_en string")
    matcher = vocabulary.Matcher(vocabulary._names(ref, {})["category"])
    value = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in reversed(range(80)))
    assert matcher.match(value) == "x" and matcher.match(value[:300]) == "none"


def test_aliases_may_be_a_table(spark):
    ref = spark.createDataFrame(REFERENCE, "list_name string, ref_code string, label_ru string, label_en string")
    more = spark.createDataFrame([("category", "spot", "punktstrahler"), ("category", "gone", "x"), (None, None, None)], "list_name string, ref_code string, alias string")
    df = spark.createDataFrame([(1, "Punktstrahler weiß"), (2, "x"), (3, "спот")], "product_id long, category string")
    got = {r.product_id: r.ref_code for r in vocabulary.map_values(df, "product_id", {"category": ("category", False)}, ref, more).collect()}
    assert got == {1: "spot", 2: "none", 3: "spot"}
