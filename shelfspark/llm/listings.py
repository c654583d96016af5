"""Product listings that describe the same item.

1. Every listing becomes a title in one form plus what can be read off it: code, size, wattage,
   colour, series words, whether it is a spare part. What one listing of a code lacks is completed
   from the others of that code, its series also from those of its model.
2. A subword encoder, trained contrastively on listings that share a maker's code, turns titles
   into unit vectors. The same labelled pairs give the least similarity of listings of one product.
3. An inverted-file index over all vectors gives each listing the lists near it; how many are probed
   is tuned against exact neighbours on a sample.
4. Two listings are mutual neighbours if each lies in a list that the other probes and they are at
   least as similar as labelled pairs are. Mutual neighbours are linked, however many, unless a veto
   forbids it: codes, sizes, wattages, colours or series that contradict each other. Connected
   listings are one product. Listings of one code, and those with all the same values, are joined
   exactly besides.
5. A listing that lacks a code and one of size, wattage, colour and series joins the product of its
   mutual neighbours that nothing speaks against, if that is one only.

Exact copies of a title are looked up once, the same values compared once a list. Cells are cut to
parts of a bounded length on both sides, of the links of a part a spanning forest is kept, and
components are found by rounds of label passing over written tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.unify import unify
from shelfspark.llm.vocabulary import ALIASES, _plain, edits, transliterate
from shelfspark.operators.units import AXES, _name_sizes, _UNIT_KEY, resolve_sizes, stated_unit, to_mm
from shelfspark.operators.vectors import search
from shelfspark.session import blocks, cut_lineage

#: Rows of the bounded sample the encoder and the lists' centres are fitted on.
SAMPLE_ROWS = 16_000
DIM, BUCKETS = 48, 1 << 15
#: Lists that lie near each other and are searched in one task; rows of them that one task holds.
LISTS_A_CELL, CELL_ROWS = 16, 20_000
#: Pairs that are compared at once.
PAIRS = 2_000_000
#: Shares of what the probed lists must hold: of all pairs that only the index can link, and of the
#: ten nearest whatever they are.
LINKED, NEAREST = 0.9995, 0.92
#: Share of the labelled pairs that are less similar than the least similarity; pairs it takes.
LEAST, LEAST_PAIRS = 0.0001, 50
#: Allowance on it, as the sample doesn't hold the least similar pair of all.
SLACK = 0.05
SIZE_TOLERANCE_MM = 4

_CODE = regex.compile(r"(?<![\p{L}\d])(\p{Lu}{2,4})[ ]?(\d{6,8})[-/ .]?(\d\d)(\p{Lu}{2})?(-?SP)?(?![\p{L}\d])")
_SPARE = regex.compile(r"запасн|сменн\w* плафон|плафон\w* сменн|\bspare\b|\breplacement\b|ersatz|запчаст", regex.I)
_WATT = regex.compile(r"(\d+(?:[.,]\d+)?)\s?(?:w|вт|watt|ватт)(?!\p{L})", regex.I)
_SPEC_WATT = regex.compile(r"^(?:мощность|power|leistung)\s*[:—–-]\s*(\d+(?:[.,]\d+)?)", regex.I | regex.M)
_SPEC_COLOUR = regex.compile(r"^(?:цвет|colour|color|farbe)\s*[:—–-]\s*(.+)$", regex.I | regex.M)
COLOURS = {
    "black": r"ч[её]рн|black|schwarz", "white": r"\bбел(?:ы|а|о)|white|weiß|weiss", "gold": r"золот|\bgold", "nickel": r"никел|nickel", "chrome": r"хром|chrom", "bronze": r"бронз|bronze",
    "copper": r"\bмед[ьн]|copper|kupfer", "brass": r"латун|brass|messing", "grey": r"\bсер(?:ый|ая|ое)|gr[ae]y|\bgrau", "green": r"зел[её]н|green|grün", "blue": r"\bсин(?:ий|яя|ее)|\bblue|\bblau", "wood": r"дерев|wood|holz",
    "red": r"красн|\bred\b|\brot\b", "silver": r"серебр|silver|silber", "beige": r"бежев|beige", "brown": r"коричн|brown|braun", "transparent": r"прозрачн|transparent|\bclear\b",
}
_COLOURS = [(name, regex.compile(p, regex.I)) for name, p in COLOURS.items()]
_ANY_COLOUR = regex.compile("|".join(COLOURS.values()), regex.I)
#: Words of titles that say nothing about which product it is.
FILLERS = (
    "для дома в гостиную и спальню с гарантией хит новинка лучшая цена бесплатная доставка стильный дизайнерский современный дизайн цвет ширина диаметр высота светлое запасной плафон сменный к модели купить недорого поворотный "
    "for living room new modern designer best seller free shipping limited offer top quality jet wooden width diameter height spare shade colour color with and the lighting light lamp "
    "für wohnzimmer neu bestseller hochwertig modern ersatzschirm breite höhe durchmesser farbe mit und watt ватт zoll inch inches дюйм дюйма дюймов"
).split()
_NUMBERED = regex.compile(r"\S*\d\S*")
_WORDS = regex.compile(r"\p{L}{3,}")


@lru_cache(maxsize=200_000)
def _skeleton(word: str) -> str:
    """Latin spelling by sound, so that a transliterated name meets its original."""
    w = transliterate(word.casefold().replace("ё", "е"))
    for a, b in (("qu", "kv"), ("sch", "sh"), ("ck", "k"), ("ph", "f"), ("x", "ks"), ("w", "v"), ("c", "k"), ("q", "k"), ("j", "y"), ("y", "i"), ("h", "")):
        w = w.replace(a, b)
    return regex.sub(r"(.)\1", r"\1", w)


@lru_cache(maxsize=1)
def _stop_words() -> frozenset[str]:
    """Skeletons of the words that name kinds or fill titles."""
    kinds = {w for names in ALIASES["category"].values() for n in names for w in _plain(n).split()}
    kinds |= {"светильник", "светильники", "лампа", "лампы", "подсветка", "зеркала", "потолочная", "downlight", "spotlight", "ceiling", "wall", "table", "floor", "outdoor", "mirror", "picture", "linear", "track", "recessed", "surface", "pendant", "hanging", "sconce"}
    return frozenset(_skeleton(w) for w in [*kinds, *FILLERS])


class Reader:
    """Reads what identifies the product off a listing."""

    def __init__(self, brands: list[str]) -> None:
        self.stop = _stop_words()
        self.brands = {_skeleton(w) for b in brands for w in _plain(b).split() if len(w) >= 3}
        self.brand_letters = [(b, set(b)) for b in sorted(self.brands) if len(b) >= 4]
        self.known: dict[str, bool] = {}
        self.words: dict[str, str | None] = {}

    def distinctive(self, word: str) -> bool:
        """Whether a word (as a skeleton) may name a series: no kind, colour, filler or maker."""
        got = self.known.get(word)
        if got is None:
            got = len(word) >= 4 and word not in self.stop and word not in self.brands
            if got and len(word) >= 5:
                letters = set(word)
                for b, of_b in self.brand_letters:
                    most = 2 if len(b) >= 7 else 1
                    if abs(len(b) - len(word)) <= most and len(letters ^ of_b) <= 2 * most and edits(word, b, most) <= most:
                        got = False
                        break
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = got
        return got

    def named(self, word: str) -> str | None:
        """The skeleton of a word that may name a series; null for all others."""
        if word not in self.words:
            if len(self.words) > 300_000:
                self.words.clear()
            s = _skeleton(word)
            self.words[word] = s if _ANY_COLOUR.search(word) is None and self.distinctive(s) else None
        return self.words[word]

    def series(self, name: str, columns: list[str | None], brand: str | None) -> list[str]:
        maker = {_skeleton(w) for w in _WORDS.findall(brand or "")}
        out: dict[str, None] = {}
        for text in (*columns, name):
            if not text:
                continue
            for w in _WORDS.findall(_NUMBERED.sub(" ", text)):
                s = self.named(w)
                if s is not None and s not in maker:
                    out[s] = None
        return list(out)


def colour_of(*texts: str | None) -> str | None:
    for t in texts:
        if t and _ANY_COLOUR.search(t):
            for name, p in _COLOURS:
                if p.search(t):
                    return name
    return None


def code_of(*texts: str | None) -> str | None:
    """The maker's code in one notation: letters, digits, number of the variant, colour, SP."""
    for t in texts:
        if t and (m := _CODE.search(t.upper())):
            return f"{m[1]}{m[2]}-{m[3]}{m[4] or ''}{'-SP' if m[5] else ''}"
    return None


class Listing(NamedTuple):
    title: str
    code: str | None
    spare: bool
    size: float | None
    height: float | None
    watt: float | None
    colour: str | None
    series: list[str]


def listing_features(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One row per product row with what identifies it; null names are empty titles."""
    hosts = suppliers.select("host", "evidence", "brands").dropDuplicates(["host"]).limit(100_001).collect()
    if len(hosts) > 100_000:
        raise ValueError("the shops' table is longer than a table that is sent to every worker may be")
    units = {r["host"]: stated_unit(r["evidence"]) for r in hosts}
    brands = sorted({b for r in hosts for b in r["brands"] or [] if b})
    axes = list(AXES)
    entries = F.map_entries("attributes")
    card = F.try_element_at(F.transform(F.filter(entries, lambda e: F.lower(F.trim(e["key"])).rlike(_UNIT_KEY.pattern)), lambda e: e["value"]), F.lit(1))
    of = lambda *names: F.try_element_at(F.transform(F.filter(entries, lambda e: F.lower(e["key"]).isin(*names)), lambda e: e["value"]), F.lit(1))
    rows = products.select(
        "product_id", "supplier", "name", "sku", "brand", "series", "collection", "color", "wattage", "description", "dimensions", *axes, *[f"{a}_mm" for a in axes],
        card.alias("_card"), of("мощность", "power", "leistung").alias("_w"), of("цвет", "colour", "color", "farbe").alias("_c"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(brands)
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                text = lambda c: unify(r[c]) if isinstance(r[c], str) else None  # noqa: E731,B023
                name, sku = text("name") or "", unify(r["sku"], True) if isinstance(r["sku"], str) else None
                number = lambda c: None if r[c] is None or r[c] != r[c] else float(r[c])  # noqa: E731,B023
                unit = (to_mm(1.0, r["_card"]) if isinstance(r["_card"], str) else None) or units.get(r["supplier"])
                sizes = resolve_sizes(r["dimensions"], {a: number(a) for a in axes}, {a: number(f"{a}_mm") for a in axes}, unit, r["name"])
                named = _name_sizes(_CODE.sub(" ", name))
                size = sizes.get("diameter") or sizes.get("width") or (named[0] if named else None)
                text_ = r["description"] if isinstance(r["description"], str) else ""
                w = _WATT.search(name) or (_WATT.search(text("_w") or "")) or _SPEC_WATT.search(text_)
                watt = number("wattage") if number("wattage") is not None else float(w[1].replace(",", ".")) if w else None
                c = _SPEC_COLOUR.search(text_)
                code = code_of(sku, name)
                spare = bool(_SPARE.search(name)) or bool(code and code.endswith("-SP"))
                if code and spare and not code.endswith("-SP"):
                    code += "-SP"  # shops list spare parts under the product's code, too
                out.append((r["product_id"], " ".join(name.casefold().split()), code, spare, size, sizes.get("height"), watt, colour_of(name, text("color"), text("_c"), c and c[1]), reader.series(name, [text("series"), text("collection")], text("brand"))))
            yield pd.DataFrame(out, columns=["product_id", *Listing._fields]).astype({"size": "float64", "height": "float64", "watt": "float64"})

    return rows.mapInPandas(run, "product_id bigint, title string, code string, spare boolean, size double, height double, watt double, colour string, series array<string>")


def complete(listings: DataFrame) -> DataFrame:
    """Fills what a listing lacks from the other listings of its code (the most frequent value), and
    the series also from those of its model, the code without the variant. Listings without a code
    take no part in the joins, so they don't gather under one key."""
    clean = ["size", "height", "watt"]
    base = listings.select("*", *[F.when(~F.isnan(c), F.col(c)).alias(f"_{c}") for c in clean]).drop(*clean).withColumnsRenamed({f"_{c}": c for c in clean})
    coded = base.filter("code is not null").withColumn("_model", F.substring_index("code", "-", 1))
    known = coded.groupBy("code").agg(*[F.mode(c, True).alias(f"_{c}") for c in ("size", "height", "watt", "colour")], F.mode(F.try_element_at("series", F.lit(1)), True).alias("_series"))
    models = coded.filter(F.size("series") > 0).groupBy("_model").agg(F.mode(F.try_element_at("series", F.lit(1)), True).alias("_of_model"))
    both = coded.join(known, "code", "left").join(models, "_model", "left").withColumn("_series", F.coalesce("_series", "_of_model"))
    filled = {c: F.coalesce(c, f"_{c}") for c in ("size", "height", "watt", "colour")}
    series = F.when(F.col("_series").isNull(), F.col("series")).otherwise(F.array_distinct(F.concat("series", F.array("_series"))))
    return both.withColumns(filled | {"series": series}).select(*base.columns).unionByName(base.filter("code is null"))


def grams(title: str, code: str | None, size: float | None, watt: float | None, colour: str | None, series: list[str], spare: bool) -> np.ndarray:
    """Hashed subwords and values of a listing; what the encoder sums up. Words that only name a
    kind or fill the title are left out; the code's model stands in where no series is named."""
    out: list[int] = []
    for w in _WORDS.findall(_NUMBERED.sub(" ", title)):
        word = _skeleton(w)
        if word not in _stop_words():
            out += _word_grams(word)
    for s in series:
        out += [*[_bucket("s" + s)] * 3, _bucket("t" + s[:5]), _bucket("u" + s[-5:])]
    if code and not series:
        out += [_bucket("b" + code.split("-")[0])] * 3
    if size is not None and size == size:
        out += [_bucket(f"z{round(size / 10)}")] * 3
    if watt is not None and watt == watt:
        out += [_bucket(f"p{watt:g}")] * 3
    if colour:
        out += [_bucket("k" + colour)] * 3
    if spare:
        out += [_bucket("spare")] * 3
    return np.array(out or [0], np.int32)


@lru_cache(maxsize=200_000)
def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


@lru_cache(maxsize=200_000)
def _word_grams(word: str) -> tuple[int, ...]:
    p = f"<{word}>"
    return tuple(zlib.crc32(g.encode()) % BUCKETS for g in ("w" + word, *(p[i : i + 4] for i in range(len(p) - 3))))


def _sums(bags: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Unit vectors of bags of buckets, a few thousand at a time."""
    out = np.zeros((len(bags), weights.shape[1]), np.float32)
    for lo in range(0, len(bags), 2048):
        part = bags[lo : lo + 2048]
        starts = np.concatenate(([0], np.cumsum([len(b) for b in part])[:-1]))
        v = np.add.reduceat(weights[np.concatenate(part)], starts, axis=0)
        out[lo : lo + 2048] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return out


def _by_key(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(rows[order], first, axis=0)


def train(bags: list[np.ndarray], labels: list[str], steps: int = 300, batch: int = 192, seed: int = 7) -> np.ndarray:
    """Contrastive training: two listings of one code attract, the batch's others repel. Batches
    hold neighbouring codes, so variants of one model are the hard negatives."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 1, (BUCKETS, DIM)).astype(np.float32)
    groups: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        groups.setdefault(label, []).append(i)
    codes = sorted(c for c, g in groups.items() if len(g) > 1)
    if len(codes) < 4:
        return weights
    scale, rate, temper = np.full((BUCKETS, 1), 1e-3, np.float32), 0.3, 0.07
    for _ in range(steps):
        start = int(rng.integers(0, len(codes)))
        near = [codes[(start + k) % len(codes)] for k in range(min(batch // 2, len(codes)))]
        far = [codes[k] for k in rng.integers(0, len(codes), batch - len(near))]
        picked = [rng.choice(groups[c], 2, replace=False) for c in dict.fromkeys(near + far)]
        left, right = [bags[a] for a, _ in picked], [bags[b] for _, b in picked]
        va, vb = _sums(left, weights), _sums(right, weights)
        p = va @ vb.T / temper
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - np.eye(len(p), dtype=np.float32)) / temper / len(p)
        ga, gb = g @ vb, g.T @ va
        for bag, v, grad in ((left, va, ga), (right, vb, gb)):
            grad = grad - (grad * v).sum(1, keepdims=True) * v  # along the unit sphere
            sizes = np.array([len(b) for b in bag])
            flat, total = _by_key(np.concatenate(bag), np.repeat((grad / np.sqrt(sizes)[:, None]).astype(np.float32), sizes, axis=0))
            scale[flat, 0] += (total**2).sum(1)
            weights[flat] -= rate * total / np.sqrt(scale[flat])
    return weights


def kmeans(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(vectors)))
    centres = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(b @ centres.T).argmax(1) for b in np.array_split(vectors, max(1, len(vectors) // 4096))])
        sums = np.zeros_like(centres)
        held, total = _by_key(nearest, vectors)
        sums[held] = total
        full = np.linalg.norm(sums, axis=1) > 1e-9
        centres[full] = sums[full] / np.linalg.norm(sums[full], axis=1, keepdims=True)
    return centres


def _place(vectors: np.ndarray, centres: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Of every row: how many lists are nearer to it than its list in ``lists``."""
    out = np.zeros(len(vectors), int)
    for lo in range(0, len(vectors), 2048):
        sims = vectors[lo : lo + 2048] @ centres.T
        out[lo : lo + 2048] = (sims > np.take_along_axis(sims, lists[lo : lo + 2048, None], 1)).sum(1)
    return out


def tune_probes(vectors: np.ndarray, centres: np.ndarray, agreeing, queries: int = 4000, k: int = 10) -> tuple[int, float, float]:
    """The fewest lists to probe that hold ``LINKED`` of all pairs ``agreeing`` (of row numbers of
    queries: pairs of query and row) gives, each in the lists of the other, however far they are,
    and ``NEAREST`` of the k nearest; both shares as measured."""
    n = len(vectors)
    of = (vectors @ centres.T).argmax(1)
    linked, nearest = [np.zeros(0, int)], [np.zeros(0, int)]
    for lo in range(0, min(queries, n), 100):
        q = vectors[lo : lo + 100]
        sims = q @ vectors.T
        sims[np.arange(len(q)), np.arange(lo, lo + len(q))] = -2
        top = min(k, n)
        best = np.argpartition(-sims, top - 1, axis=1)[:, :top]
        i, j = agreeing(np.arange(lo, lo + len(q)))
        i, j = i[i != j], j[i != j]
        linked.append(np.maximum(_place(vectors[i], centres, of[j]), _place(vectors[j], centres, of[i])))
        near = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)
        nearest.append(np.take_along_axis(near, of[best], 1).ravel())
    a, b = np.concatenate(linked), np.concatenate(nearest)
    share = lambda r, p: float((r < p).mean()) if len(r) else 1.0
    probes = 1
    while probes < len(centres) and (share(a, probes) < LINKED or share(b, probes) < NEAREST):
        probes += 1
    return probes, share(a, probes), share(b, probes)


def least_similarity(vectors: np.ndarray, codes: list[str | None]) -> float:
    """The ``LEAST`` quantile of the similarities of labelled pairs (a code's first row and its
    others), less ``SLACK``; -1, which forbids nothing, if there are fewer than ``LEAST_PAIRS``."""
    first: dict[str, int] = {}
    pairs = [(first.setdefault(c, i), i) for i, c in enumerate(codes) if isinstance(c, str)]
    a, b = (np.array([p[n] for p in pairs if p[0] != p[1]], int) for n in (0, 1))
    return float(np.quantile((vectors[a] * vectors[b]).sum(1), LEAST)) - SLACK if len(a) >= LEAST_PAIRS else -1.0


class Index(NamedTuple):
    weights: np.ndarray
    centres: np.ndarray
    cell: np.ndarray  # of every list
    probes: int
    linked: float
    nearest: float
    least: float


def _bags(pdf: pd.DataFrame, coded: bool = True) -> list[np.ndarray]:
    number = lambda x: None if x is None or x != x else float(x)
    return [grams(t or "", c if coded else None, number(z), number(w), k, list(s) if s is not None else [], bool(p)) for t, c, z, w, k, s, p in zip(pdf["title"], pdf["code"], pdf["size"], pdf["watt"], pdf["colour"], pdf["series"], pdf["spare"])]


def fit(listings: DataFrame, rows: int, sample: int = SAMPLE_ROWS) -> Index:
    """Encoder, centres and number of probes, fitted on at most ``sample`` rows in the order of a
    hash of their code (whole groups, so the sample has pairs to learn from); ``rows`` is the
    number of listings to be indexed."""
    got = listings.orderBy(F.xxhash64(F.coalesce("code", F.array_join("series", " "))), "product_id").limit(sample).toPandas()
    if got.empty:
        return Index(np.zeros((BUCKETS, DIM), np.float32), np.zeros((1, DIM), np.float32), np.zeros(1, int), 1, 1.0, 1.0, -1.0)
    # the code is left out of the views that are trained on, so the words and values are learnt
    labelled = got[got["code"].notna()]
    weights = train(_bags(labelled, coded=False), labelled["code"].tolist())
    vectors = _sums(_bags(got), weights)
    centres = kmeans(vectors, max(1, round(rows**0.5)))
    keyed = got.assign(code_h=[None if c is None else zlib.crc32(c.encode()) + 1 for c in got["code"]], series=[[zlib.crc32(x.encode()) + 1 for x in s] for s in got["series"]])
    keys = _columns(keyed)
    mixed = np.random.default_rng(7).permutation(len(vectors))
    keys = {c: v[mixed] for c, v in keys.items()}
    tuned = tune_probes(vectors[mixed], centres, lambda i: _agreeing(keys, i, keys, np.arange(len(mixed))))
    cells = kmeans(centres, max(1, round(len(centres) / LISTS_A_CELL)))
    return Index(weights, centres, (centres @ cells.T).argmax(1), *tuned, least_similarity(vectors, got["code"].tolist()))


_SAME = ["title", "code", "spare", "size", "height", "watt", "colour", "series"]


def _keyed(listings: DataFrame) -> DataFrame:
    """The listings with two hashes of all their values, by which copies are told."""
    return listings.withColumns({"_c1": F.xxhash64(*_SAME), "_c2": F.xxhash64(F.lit(7), *_SAME)})


def encode(listings: DataFrame, index: Index) -> DataFrame:
    """Vectors of distinct listings (half precision, and in bytes), the list and cell they are kept
    in, and their values. rid is the smallest id of listings that are copies of one another."""
    distinct = _keyed(listings).groupBy("_c1", "_c2").agg(F.min_by(F.struct("product_id", *_SAME), "product_id").alias("_r")).select(F.col("_r.product_id").alias("rid"), *[F.col(f"_r.{c}").alias(c) for c in _SAME])
    spread = distinct.sparkSession.sparkContext.broadcast(index)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = spread.value
        for pdf in frames:
            v = _sums(_bags(pdf), ix.weights)
            home = (v @ ix.centres.T).argmax(1)
            small = np.round(v * 127).astype(np.int8)
            yield pd.DataFrame({"rid": pdf["rid"], "vec": [x.tobytes() for x in v.astype(np.float16)], "bytes": [x.tobytes() for x in small], "list": home.astype(np.int32), "cell": ix.cell[home].astype(np.int32), **{c: pdf[c] for c in _SAME[1:]}})

    kinds = "code string, spare boolean, size double, height double, watt double, colour string, series array<string>"
    vectors = distinct.mapInPandas(run, f"rid bigint, vec binary, bytes binary, list int, cell int, {kinds}")
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in ("size", "height", "watt")}  # pandas knows no null number
    return vectors.withColumns(known | {"code_h": F.when(F.col("code").isNotNull(), F.xxhash64("code")), "series": F.transform("series", lambda x: F.xxhash64(x))}).drop("code")


def with_lists(vectors: DataFrame, index: Index) -> DataFrame:
    """The vectors with the lists they probe (``asked``), and those of them where their pairs are
    compared, by cell (``asks``): of two mutual neighbours the one of the lesser list goes to the
    other's."""
    spread = vectors.sparkSession.sparkContext.broadcast(index)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select("rid", "vec", "list").schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = spread.value
        for pdf in frames:
            near = _floats(pdf["vec"]) @ ix.centres.T
            near[np.arange(len(near)), pdf["list"].to_numpy()] = 2  # its own list, come what may
            lists = np.sort(np.argpartition(-near, ix.probes - 1, axis=1)[:, : ix.probes], axis=1).astype(np.int32)
            asks = []
            for row, own in zip(lists, pdf["list"]):
                later = row[row >= own]
                of = ix.cell[later]
                asks.append([{"cell": int(c), "lists": later[of == c]} for c in np.unique(of)])
            yield pdf[["rid", "vec", "list"]].assign(asked=list(lists), asks=asks)

    asked = vectors.select("rid", "vec", "list").mapInPandas(run, f"{schema}, asked array<int>, asks array<struct<cell:int,lists:array<int>>>")
    return vectors.join(asked.select("rid", "asked", "asks"), "rid")


def _floats(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float16).reshape(len(vectors), -1).astype(np.float32)


def _nearest(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rid of the k nearest of every row of ``asked`` in all ``vectors``, by brute force."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"rid": pdf["rid"], "v": list(_floats(pdf["vec"]))})

    floats = lambda df: df.select("rid", "vec").mapInPandas(run, "rid bigint, v array<float>")
    return search(floats(vectors), floats(asked), "rid", "v", k + 1).filter("query_id <> rid").select("query_id", "rid")


def check_probes(vectors: DataFrame, index: Index, queries: int = 500, k: int = 10) -> Index:
    """The index with as many lists to probe as hold ``NEAREST`` of the exact k nearest, in all rows,
    of ``queries`` rows in the order of a hash; at least as many as were tuned."""
    asked = cut_lineage(vectors.select("rid", "vec").orderBy(F.xxhash64("rid"), "rid").limit(queries))
    near = _nearest(vectors, asked, k).join(vectors.select("rid", "list"), "rid").select("query_id", "list").toPandas()  # queries * (k + 1) rows
    if near.empty:
        return index
    of = asked.toPandas()
    row = pd.Series(np.arange(len(of)), of["rid"]).loc[near["query_id"]].to_numpy()
    place = _place(_floats(of["vec"])[row], index.centres, near["list"].to_numpy())
    probes = index.probes
    while probes < len(index.centres) and (place < probes).mean() < NEAREST:
        probes += 1
    return index._replace(probes=probes, nearest=float((place < probes).mean()))


def _agree(a: dict[str, np.ndarray], i: np.ndarray, b: dict[str, np.ndarray], j: np.ndarray) -> np.ndarray:
    """Which pairs of listings nothing speaks against, by their numbers and variants."""
    ca, cb = a["code_h"][i], b["code_h"][j]
    coded = (ca != 0) & (cb != 0)
    shared = _share(a, i, b, j)
    return np.where(coded, (ca == cb) & (a["spare"][i] == b["spare"][j]), shared & _close(a, i, b, j))


def _share(a: dict[str, np.ndarray], i: np.ndarray, b: dict[str, np.ndarray], j: np.ndarray) -> np.ndarray:
    """Which pairs share a word of the series."""
    shared = np.zeros(len(i), bool)
    sa, sb = a["series"][i], b["series"][j]
    for x in range(sa.shape[1]):
        for y in range(sb.shape[1]):
            shared |= (sa[:, x] == sb[:, y]) & (sa[:, x] != 0)
    for n in np.flatnonzero(~shared & (a["wide"][i] | b["wide"][j])):
        shared[n] = not set(a["words"][i[n]]).isdisjoint(b["words"][j[n]])
    return shared


def _close(a: dict[str, np.ndarray], i: np.ndarray, b: dict[str, np.ndarray], j: np.ndarray, missing: bool = False) -> np.ndarray:
    """Which pairs agree in the values that are quickly compared; ``missing``: a value that one of
    them lacks is no veto."""
    with np.errstate(invalid="ignore"):
        size = np.abs(a["size"][i] - b["size"][j])
        watt = np.abs(a["watt"][i] - b["watt"][j])
        height = ~(np.abs(a["height"][i] - b["height"][j]) > 12)
    size, watt = (~(size > SIZE_TOLERANCE_MM), ~(watt >= 0.05)) if missing else (size <= SIZE_TOLERANCE_MM, watt < 0.05)
    ka, kb = a["colour"][i], b["colour"][j]
    colour = (ka == kb) | ((ka == 0) | (kb == 0)) if missing else (ka == kb) & (ka != 0)
    return (a["spare"][i] == b["spare"][j]) & size & watt & colour & height


def _columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    series = np.zeros((len(pdf), 6), np.int64)
    words = np.empty(len(pdf), object)
    for r, s in enumerate(pdf["series"]):
        words[r] = () if s is None else tuple(s)
        series[r, : min(6, len(words[r]))] = words[r][:6]
    colour = np.array([0 if c is None else zlib.crc32(c.encode()) + 1 for c in pdf["colour"]], np.int64)
    code = np.array([0 if c is None or c != c else int(c) for c in pdf["code_h"]], np.int64)
    size, watt = pdf["size"].to_numpy(float), pdf["watt"].to_numpy(float)
    lacks = np.isnan(size).astype(int) + np.isnan(watt) + (colour == 0) + np.array([len(w) == 0 for w in words], int)
    wide = np.array([len(w) > 6 for w in words], bool)
    return {"code_h": code, "spare": pdf["spare"].to_numpy(bool), "size": size, "height": pdf["height"].to_numpy(float), "watt": watt, "colour": colour, "series": series, "words": words, "wide": wide, "lacks": lacks, "named": np.array([len(w) for w in words], int)}


def _agreeing(a: dict[str, np.ndarray], rows: np.ndarray, b: dict[str, np.ndarray], others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (of ``rows``, of ``others``) that agree, but for pairs of two codes, which are
    joined exactly."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    coded, other_coded = a["code_h"][rows] != 0, b["code_h"][others] != 0
    for mine, theirs in ((rows[coded], others[~other_coded]), (rows[~coded], others)):
        step = max(1, PAIRS // max(1, len(theirs)))
        for lo in range(0, len(mine), step):
            m = mine[lo : lo + step]
            ok = _close(a, m[:, None], b, theirs[None, :])
            i, j = np.nonzero(ok)
            i, j = m[i], theirs[j]
            good = _agree(a, i, b, j)
            out.append((i[good], j[good]))
    return tuple(np.concatenate([x[n] for x in out]) if out else np.zeros(0, int) for n in (0, 1))


def _may_agree(a: dict[str, np.ndarray], rows: np.ndarray, b: dict[str, np.ndarray], others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a listing without a code that lacks one of size, wattage, colour and series, and
    one with a code or all of them, that nothing speaks against."""
    mine, theirs = rows[(a["code_h"][rows] == 0) & (a["lacks"][rows] == 1)], others[(b["code_h"][others] != 0) | (b["lacks"][others] == 0)]
    out = [(np.zeros(0, int), np.zeros(0, int))]
    step = max(1, PAIRS // max(1, len(theirs)))
    for lo in range(0, len(mine), step):
        i, j = np.nonzero(_close(a, mine[lo : lo + step][:, None], b, theirs[None, :], True))
        i, j = mine[lo : lo + step][i], theirs[j]
        good = _share(a, i, b, j) | (a["named"][i] == 0) | (b["named"][j] == 0)
        out.append((i[good], j[good]))
    return tuple(np.concatenate([x[n] for x in out]) for n in (0, 1))


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the graph of the pairs (a, b) of places in ``ids``: each id but a component's smallest,
    and that smallest id. It connects what the pairs connect, in at most one row for an id."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    a, b = place[a], place[b]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(ids)))
    return ids[order][root[at]], ids[order][at]


def same_values(encoded: DataFrame) -> DataFrame:
    """(a, b) from the smallest id of all listings of one code, and of all listings without a code
    that have the same values and agree with themselves, to each other of them."""
    coded = encoded.filter("code_h is not null").select(F.col("rid").alias("b"), F.struct("code_h", "spare").alias("g"))
    full = "code_h is null and colour is not null and size(series) > 0 and not isnan(size) and size is not null and not isnan(watt) and watt is not null"
    plain = encoded.filter(full).select(F.col("rid").alias("b"), F.struct("spare", "size", "height", "watt", "colour", F.array_sort("series").alias("series")).alias("g"))
    pairs = []
    for rows in (coded, plain):
        least = rows.groupBy("g").agg(F.min("b").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
        pairs.append(rows.join(least, "g").filter("a < b").select("a", "b"))
    return pairs[0].unionByName(pairs[1])


def links(encoded: DataFrame, least: float = -1.0) -> DataFrame:
    """(a, b), a < b, of ``all_links`` that are sure."""
    return all_links(encoded, least).filter("sure").select("a", "b")


def _mutual(mine: pd.DataFrame, theirs: pd.DataFrame, least: float):
    """A test of pairs (row of ``theirs``, row of ``mine``): does mine probe the list of theirs, and
    are they similar enough. That theirs probes the list of mine is what brought them here."""
    lists = theirs["list"].to_numpy().astype(np.int64)
    sizes = mine["asked"].map(len).to_numpy()
    asked = np.concatenate(mine["asked"].to_list()).astype(np.int64)
    width = int(max(asked.max(initial=0), lists.max(initial=0))) + 1
    probed = np.sort(np.repeat(np.arange(len(mine)), sizes) * width + asked)
    vectors = [np.frombuffer(b"".join(x["bytes"]), np.int8).reshape(len(x), -1) for x in (theirs, mine)]

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        key = j * width + lists[i]
        at = np.minimum(np.searchsorted(probed, key), len(probed) - 1)
        ok = probed[at] == key
        for lo in range(0, len(i), 200_000):
            a, b = (v[n[lo : lo + 200_000]].astype(np.float32) for v, n in zip(vectors, (i, j)))
            ok[lo : lo + 200_000] &= (a * b).sum(1) >= (least - 0.01) * 127 * 127  # a hundredth for the bytes
        return ok

    return test


def all_links(encoded: DataFrame, least: float = -1.0) -> DataFrame:
    """(a, b, sure). Sure ones, a < b, connect every listing with all its mutual neighbours that
    nothing speaks against; the others: a lacks a value, and may be the product of b. A listing is
    sent once to every cell that holds lists it asks; a task gives a spanning forest of the links it
    finds, so none is left out and no more rows come out than its listings. A cell's members and its
    askers are cut to parts of ``CELL_ROWS``, and every part meets every other."""
    node = F.when(F.col("code_h").isNull(), F.xxhash64("spare", "size", "height", "watt", "colour", F.array_sort("series"))).otherwise(F.xxhash64("code_h", "spare", "size", "height", "watt", "colour", F.array_sort("series")))
    encoded = encoded.drop("vec").withColumn("node", node)
    members, asking = encoded.drop("asks"), encoded.drop("cell", "asked").withColumn("ask", F.explode("asks")).select("*", "ask.cell", "ask.lists").drop("asks", "ask")
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name))
    grid = parts(members, "parts").join(parts(asking.select("cell"), "bands"), "cell")
    # one row of sizes a cell, so the join doesn't move a cell's rows to one task: see AQE's size check
    cut = lambda df, own, name, other, many: df.join(grid, "cell").withColumn(name, F.pmod(F.xxhash64("rid"), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(many) - 1))).drop("parts", "bands")
    members, asking = cut(members, "parts", "part", "band", "bands"), cut(asking, "bands", "band", "part", "parts")
    asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])  # columns of its own

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "sure": pd.Series(dtype="bool")})
        mk, mnode, qk, qnode = _columns(mine), mine["node"].to_numpy(), _columns(theirs), theirs["node"].to_numpy()
        mutual = _mutual(mine, theirs, least)
        kept_in, from_ = mine["list"].to_numpy(), theirs["list"].to_numpy()
        sizes = theirs["lists"].map(len).to_numpy()
        asker, asked = np.repeat(np.arange(len(theirs)), sizes), np.concatenate(theirs["lists"].to_list())
        # listings with the same values agree with the same others, so one of them is compared;
        # each is linked with that one, unless it is of those that lack a value to agree with themselves
        ids, place = np.unique(np.concatenate((mine["rid"].to_numpy(), theirs["rid"].to_numpy())), return_inverse=True)
        mplace, qplace = place[: len(mine)], place[len(mine) :]
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        may = [np.zeros((0, 2), np.int64)]
        for one in np.unique(kept_in):
            there, who = np.flatnonzero(kept_in == one), asker[asked == one]
            if not len(who):
                continue
            # within a list the representatives of members and askers are the same; across lists not
            mvalue, m1, m_of = np.unique(mnode[there], return_index=True, return_inverse=True)
            _, q1, q_of = np.unique(np.column_stack((qnode[who], from_[who])), axis=0, return_index=True, return_inverse=True)
            q_of = q_of.ravel()
            i, j = _may_agree(qk, who, mk, there[m1])
            back_j, back_i = _may_agree(mk, there, qk, who[q1])
            for x, y, pairs in ((i, j, lambda g: (qplace[i[g]], mplace[j[g]])), (back_i, back_j, lambda g: (mplace[back_j[g]], qplace[back_i[g]]))):
                if len(x) and (good := mutual(x, y)).any():
                    may.append(np.unique(np.column_stack(pairs(good)), axis=0))
            i, j = _agreeing(qk, who[q1], mk, there[m1])
            good = mutual(i, j)
            i, j = i[good], j[good]
            # the first of the same values stands for all that found or were found
            first_m, first_q = np.full(len(mine), -1), np.full(len(theirs), -1)
            first_m[there], first_q[who] = there[m1][m_of], who[q1][q_of]
            hit_m, hit_q = there[np.isin(first_m[there], j)], who[np.isin(first_q[who], i)]
            new = [(qplace[i], mplace[j]), (mplace[hit_m], mplace[first_m[hit_m]]), (qplace[hit_q], qplace[first_q[hit_q]])]
            a, b = np.concatenate((a, *[x for x, _ in new])), np.concatenate((b, *[y for _, y in new]))
            if len(a) > PAIRS:
                a, b = (np.searchsorted(ids, x) for x in _forest(ids, a, b))
        low, high = _forest(ids, a, b)
        weak = np.concatenate(may)
        if len(weak):  # one of the listings that this task connects will do
            lowest = np.arange(len(ids))
            lowest[np.searchsorted(ids, high)] = np.searchsorted(ids, low)
            weak = np.unique(np.column_stack((weak[:, 0], lowest[weak[:, 1]])), axis=0)
        return pd.DataFrame({"a": np.concatenate((low, ids[weak[:, 0]])), "b": np.concatenate((high, ids[weak[:, 1]])), "sure": np.arange(len(low) + len(weak)) < len(low)})

    n = blocks(encoded.sparkSession)
    members, asking = members.repartition(n, "cell", "part", "band"), asking.repartition(n, "cell", "part", "band")
    return members.groupBy("cell", "part", "band").cogroup(asking.groupBy("cell", "part", "band")).applyInPandas(compare, "a bigint, b bigint, sure boolean")


def recall(encoded: DataFrame, k: int = 10) -> DataFrame:
    """(queries, neighbours, found, recall): of the exact k nearest of every listing whose id is
    divisible by 100, by brute force over all listings, those in the lists it asks."""
    flat = encoded.select("rid", "list", "asked", "vec")
    near = _nearest(flat, flat.filter("rid % 100 = 0"), k)
    at = near.join(flat.select("rid", "list"), "rid").join(flat.select(F.col("rid").alias("query_id"), "asked"), "query_id")
    return at.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.count_if(F.array_contains("asked", F.col("list"))).alias("found")).withColumn("recall", F.round(F.try_divide("found", "neighbours"), 4))


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of every id in a pair; root is the smallest id of the component.

    Rounds of passing the smallest label along the links, then to the label's own label; each
    round is written, so a lost executor costs a round at most. Ends when nothing changes.
    """
    edges = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut_lineage(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("id"), "root"))
    while True:
        seen = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(seen, labels["id"] == seen["a"]).select("id", F.least("root", "m").alias("new"), F.col("root").alias("old"))
        jump = step.select(F.col("id").alias("to"), F.col("new").alias("far"))
        step = step.join(jump, step["new"] == jump["to"]).select("id", F.least("new", "far").alias("root"), "old")
        step = cut_lineage(step)
        labels = step.select("id", "root")
        if step.filter("root <> old").isEmpty():
            return labels


def join_lacking(may: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root) with the listings of ``may`` that can be of one component only added to it; root
    stays the smallest id."""
    of = may.join(roots, may["b"] == roots["id"], "left").select("a", F.coalesce("root", "b").alias("to"))
    one = of.groupBy("a").agg(F.min("to").alias("to"), F.max("to").alias("most")).filter("to = most").select(F.col("a").alias("id"), "to")
    one = cut_lineage(one)
    roots = roots.unionByName(one.select("id", F.col("to").alias("root"))).unionByName(one.select(F.col("to").alias("id"), F.col("to").alias("root"))).distinct()
    least = one.groupBy("to").agg(F.min("id").alias("low"))
    return roots.join(least, roots["root"] == least["to"], "left").select("id", F.least("root", "low").alias("root"))


def groups(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(product_id, group_id) of every row: rows of one group show the same product; group_id is
    the group's smallest product_id. A row that matches no other is a group of its own.

    Null or empty names are matched by their other fields' values where these suffice; repeated
    rows are copies and share a group; an empty table gives none; other columns are ignored.
    """
    listings = cut_lineage(complete(cut_lineage(listing_features(products, suppliers))))  # read twice each
    index = fit(listings, listings.count())
    vectors = cut_lineage(encode(listings, index))
    encoded = cut_lineage(with_lists(vectors, check_probes(vectors, index)))
    found = cut_lineage(all_links(encoded, index.least))
    roots = components(same_values(encoded).unionByName(found.filter("sure").select("a", "b")).distinct())
    roots = join_lacking(found.filter("not sure").select("a", "b").distinct(), roots)
    of = _keyed(listings).select("product_id", "_c1", "_c2")
    of = of.join(of.groupBy("_c1", "_c2").agg(F.min("product_id").alias("rid")), ["_c1", "_c2"]).select("product_id", "rid")
    return of.join(roots, of["rid"] == roots["id"], "left").select("product_id", F.coalesce("root", "rid").alias("group_id"))


def pairs_of(grouped: DataFrame) -> DataFrame:
    """(product_id_a, product_id_b), smaller first, of all rows that share a group. The result is as
    long as a group's square; ``groups`` is the short form. The self-join is by group, and AQE cuts
    a group that is too long for a task."""
    once = grouped.select("group_id", "product_id").distinct()
    a = once.select("group_id", F.col("product_id").alias("product_id_a"))
    b = once.select("group_id", F.col("product_id").alias("product_id_b"))
    return a.join(b, "group_id").filter("product_id_a < product_id_b").select("product_id_a", "product_id_b")
