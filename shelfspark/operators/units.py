"""Quantities recorded in different units.

A unit string ("миллиметров", "cm", "дюйма", "м²", "Вт/м²", "kg·m/s²") is segmented by dynamic
programming over three tries: prefixes, roots with their inflections, and signed exponents. The
states are (position, what was read last, dimensions so far); of several ways to a state the one with
the best score is kept. A string may have several readings ("m" is metre or a bare prefix, "min"
minutes or milli-inches); each gets the sum of its pieces' scores plus the prior of the field it
stands in (a size is a length to the first power, from millimetres to metres), and the best reading
wins. Of one-letter prefixes the case counts (MW, mW); shouted ones ("ММ") are read as small ones
only with a deduction. ``product_sizes`` applies it to the sizes of catalogue cards.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings and what they mean. Scores: longer and rarer pieces are surer readings.
PREFIXES = {
    1e-6: ("микро", "micro", "mikro", "мк", "µ", "μ"), 1e-3: ("милли", "мили", "milli", "м", "m"), 1e-2: ("санти", "centi", "zenti", "с", "c"),
    1e-1: ("деци", "deci", "dezi", "д", "d"), 1e3: ("кило", "kilo", "к", "k"), 1e6: ("мега", "mega", "М", "M"),
}
#: root spelling: (dimension, factor to metre, gram, second, watt, volt, litre, kelvin, lumen)
ROOTS = {
    ("метр", "meter", "metre", "м", "m"): ("length", 1.0),
    ("дюйм", "inch", "zoll", "in", '"', "″", "”", "“", "''", "''"): ("length", 0.0254),
    ("фут", "foot", "feet", "fuss", "fuß", "ft", "'", "′"): ("length", 0.3048),
    ("ярд", "yard", "yd"): ("length", 0.9144),
    ("mil", "мил", "thou"): ("length", 2.54e-5),
    ("грамм", "gramm", "gram", "г", "гр", "g"): ("mass", 1.0),
    ("фунт", "pound", "lb"): ("mass", 453.59237),
    ("секунд", "second", "sekunde", "с", "сек", "s", "sec"): ("time", 1.0),
    ("минут", "minute", "мин", "min"): ("time", 60.0),
    ("ватт", "watt", "вт", "w"): ("power", 1.0),
    ("вольт", "volt", "в", "v"): ("voltage", 1.0),
    ("литр", "liter", "litre", "л", "l"): ("volume", 1.0),
    ("час", "hour", "stunde", "ч", "h"): ("time", 3600.0),
    ("ампер", "ampere", "amp", "а", "a"): ("current", 1.0),
    ("кельвин", "kelvin", "к", "k"): ("temperature", 1.0),
    ("люмен", "lumen", "лм", "lm"): ("flux", 1.0),
}
ENDINGS = ("", "s", "es", "n", "а", "ов", "ы", "е", "у", "ом", "ам", "ами", "ах", "ей", "и", ".")
EXPONENTS = {"": 1} | {sign + str(n): int(f"{minus}{n}") for n in (1, 2, 3, 4) for sign, minus in (("", ""), ("^", ""), ("**", ""), ("-", "-"), ("^-", "-"), ("**-", "-")) if (sign, n) != ("", 1)}
EXPONENTS |= {"¹": 1, "²": 2, "³": 3, "⁴": 4, "⁻¹": -1, "⁻²": -2, "⁻³": -3, "⁻⁴": -4}
#: Between two units: product, quotient of what stands before and the next.
OPERATORS = {"·": 1, "*": 1, "×": 1, "⋅": 1, "•": 1, "/": -1, "∕": -1, " per ": -1, " pro ": -1}
#: What a prefix costs that is read against its case; what the usual scale of a field is worth.
SHOUTED, SCALE = 0.4, 0.5
#: Prior of a reading by field: (dimension, exponent) expected there.
FIELD_PRIORS = {"size": ("length", 1), "weight": ("mass", 1), "power": ("power", 1), "voltage": ("voltage", 1)}
#: ... and the scale usual there: (least, greatest) factor.
FIELD_SCALES = {"size": (1e-3, 1.0)}


class Unit(NamedTuple):
    """dimension to the power of exponent; of compound units all dimensions ("length^-2·power"), 1."""

    dimension: str
    factor: float
    exponent: int
    score: float


def _trie(words: dict[str, list]) -> dict:
    root: dict = {}
    for word, values in words.items():
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node.setdefault(None, []).extend(values)
    return root


def _walk(trie: dict, text: str, start: int) -> Iterator[tuple[int, object]]:
    """All words of the trie that begin at ``start``: (end, value)."""
    node = trie
    for value in node.get(None, ()):
        yield start, value
    for i in range(start, len(text)):
        node = node.get(text[i])
        if node is None:
            return
        for value in node.get(None, ()):
            yield i + 1, value


@lru_cache(maxsize=1)
def _tries() -> tuple[dict, dict, dict, dict, dict]:
    prefixes: dict[str, list] = {"": [(1.0, 0.0)]}
    for factor, names in PREFIXES.items():
        for n in names:
            score = 0.3 + 0.1 * len(n)
            prefixes.setdefault(n, []).append((factor, score))
            if len(n) == 1 and factor < 1e6 and n.upper() != n:  # mega is never small
                prefixes.setdefault(n.upper(), []).append((factor, score - (0.0 if factor == 1e3 else SHOUTED)))
            elif len(n) > 1:
                for shape in {n.upper(), n.capitalize()} - {n}:
                    prefixes.setdefault(shape, []).append((factor, score))
    roots: dict[str, list] = {}
    for names, (dimension, factor) in ROOTS.items():
        for n in names:
            roots.setdefault(n, []).append((dimension, factor, 1.0 + 0.5 * len(n), len(n) > 2 and n[-1].isalpha()))
    single = lambda words: _trie({w: [(w, v)] for w, v in words.items()})
    return _trie(prefixes), _trie(roots), _trie({e: [e] for e in ENDINGS}), single(EXPONENTS), single(OPERATORS)


@lru_cache(maxsize=10_000)
def parse_unit(text: str, field: str | None = None) -> Unit | None:
    """The best reading of a unit string; None if there is none. Brackets don't matter, nor case but
    of one-letter prefixes."""
    t = unicodedata.normalize("NFC", text).strip().strip("()[]").strip()
    if not t or len(t) > 100:
        return None
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    prefixes, roots, endings, exponents, operators = _tries()
    want, scale = FIELD_PRIORS.get(field or ""), FIELD_SCALES.get(field or "", (0.0, float("inf")))
    # cells[position]: (phase, sign, dimensions so far, unit being read or, after it, the factor so
    # far, as the field's scale has a say at the end) -> (score, factor so far)
    cells: list[dict[tuple, tuple[float, float]]] = [{} for _ in range(len(t) + 1)]

    def reach(at: int, state: tuple, score: float, factor: float) -> None:
        if state not in cells[at] or cells[at][state][0] < score:
            cells[at][state] = (score, factor)

    reach(0, (0, 1, (), None), 0.0, 1.0)
    for at in range(len(t) + 1):
        for phase in range(5):  # what reads nothing stays at the position
            for state in [s for s in cells[at] if s[0] == phase]:
                score, factor = cells[at][state]
                _, sign, dims, unit = state
                if phase == 0:
                    for end, (p, gain) in _walk(prefixes, t, at):
                        reach(end, (1, sign, dims, (p,)), score + gain, factor)
                elif phase == 1:
                    for end, (dimension, f, gain, inflects) in _walk(roots, low, at):
                        reach(end, (2, sign, dims, (dimension, unit[0] * f, inflects)), score + gain, factor)
                elif phase == 2:
                    for end, ending in _walk(endings, low, at):
                        if not ending or unit[2] or ending == ".":
                            reach(end, (3, sign, dims, unit[:2]), score + 0.1 * len(ending), factor)
                elif phase == 3:
                    for end, (_, power) in _walk(exponents, low, at):
                        now = dict(dims)
                        now[unit[0]] = now.get(unit[0], 0) + sign * power
                        total = factor * unit[1] ** (sign * power)
                        reach(end, (4, 1, tuple(sorted((d, n) for d, n in now.items() if n)), total), score, total)
                else:
                    for end, (_, sign_) in _walk(operators, low, at):
                        reach(end, (0, sign_, dims, None), score, factor)
    best: Unit | None = None
    for at in range(len(t), 0, -1):
        if t[at:].strip(" ."):
            break
        for (phase, _, dims, _), (score, factor) in cells[at].items():
            if phase != 4 or not dims:
                continue
            score += (3.0 if dims == (want,) else 0.0) - (2.0 if want and want[0] not in [d for d, _ in dims] else 0.0)
            score += SCALE if want and dims == (want,) and scale[0] <= factor <= scale[1] else 0.0
            if best is None or score > best.score:
                name, power = dims[0] if len(dims) == 1 else ("·".join(d if n == 1 else f"{d}^{n}" for d, n in dims), 1)
                best = Unit(name, factor, power, score)
    return best


def to_mm(value: float, unit: str) -> float | None:
    u = parse_unit(unit, "size")
    return None if u is None or u.dimension != "length" or u.exponent != 1 else value * u.factor * 1000


_NUM = r"(?:\d{1,3}(?: \d{3})+|\d+)(?:[.,]\d+)?"
_NUMBER = re.compile(_NUM)
_TUPLE = re.compile(rf"^\s*({_NUM}(?:\s*[xх×*]\s*{_NUM})*)\s*([^\d(]*?)\s*(?:\(([^)]*)\))?\s*$", re.I)
_SPLIT = re.compile(r"\s*[;/|\n]\s*|,\s+|\s+[xх×*]\s+(?=\D|\d[\d.,]*\s*\D)", re.I)
_PACKAGE = re.compile(r"упак|короб|картон|тара|брутто|pack|box|karton|carton|verpack|versand|gross", re.I)
_WORD = re.compile(r"[^\W\d_]+\.?|[Ø⌀∅\"″”“']+")
AXES = {
    "width": ("ш", "шир", "ширина", "w", "width", "b", "breite"),
    "height": ("в", "выс", "высота", "h", "height", "höhe", "hoehe"),
    "diameter": ("ø", "⌀", "∅", "d", "д", "диам", "диаметр", "dia", "diam", "diameter", "durchmesser"),
}
_AXIS = {w: a for a, words in AXES.items() for w in words}
_INVISIBLE = re.compile(r"[­​-‏‪-‮⁠-⁤﻿]")


def _value(number: str) -> float:
    return float(number.replace(" ", "").replace(",", "."))


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))).strip()


def parse_dimensions(text: str | None) -> tuple[dict[str, float], list[float], dict[str, float]]:
    """Sizes of the product stated in a free text: (axis to mm; numbers that have neither a unit
    nor an axis; axis to number without a unit). The package's sizes are left out."""
    sizes: dict[str, float] = {}
    loose: list[float] = []
    plain: dict[str, float] = {}
    if not text:
        return sizes, loose, plain
    t = _clean(text)
    parts = [p for p in re.split(r"\s*;\s*", t) if p and not _PACKAGE.search(p)]
    pending: list[tuple[str | None, float]] = []
    for part in parts:
        m = _TUPLE.match(part)
        if m:
            numbers = [_value(x) for x in re.split(r"\s*[xх×*]\s*", m[1], flags=re.I)]
            labels = [_AXIS.get(x.strip(" .").lower()) for x in re.split(r"[xх×*]", m[3], flags=re.I)] if m[3] else []
            unit, word = m[2].strip(), m[2].strip(" .").lower()
            if m[3] and to_mm(1, m[3]) and not unit:
                unit, labels = m[3], []
            if len(labels) == len(numbers) and all(labels):
                for axis, n in zip(labels, numbers):
                    if unit and (mm := to_mm(n, unit)) is not None:
                        sizes.setdefault(axis, mm)
                    else:
                        plain.setdefault(axis, n)
                continue
            if not unit or to_mm(1, unit) is not None and word not in _AXIS and len(numbers) > 1:
                if not unit:
                    loose += numbers
                continue
        for item in _SPLIT.split(part):
            if not item or _PACKAGE.search(item):
                continue
            n = _NUMBER.search(item)
            if not n:
                continue
            number, before, after = _value(n[0]), item[: n.start()], item[n.end() :]
            axis = next((a for w in _WORD.findall(before) if (a := _AXIS.get(w.strip(".").lower()))), None)
            unit, rest = None, _WORD.findall(after)
            if rest and to_mm(1, rest[0]) is not None:
                unit, rest = rest[0], rest[1:]
            if axis is None:
                axis = next((a for w in rest if (a := _AXIS.get(w.strip(".").lower()))), None)
            if unit is None:
                pending.append((axis, number))
                continue
            if re.match(r"\s*\(", after):  # a unit in brackets holds for the numbers before it
                for a, v in pending:
                    if a:
                        sizes.setdefault(a, to_mm(v, unit))
                pending = []
            if axis:
                sizes.setdefault(axis, to_mm(number, unit))
    for axis, number in pending:
        if axis:
            plain.setdefault(axis, number)
        else:
            loose.append(number)
    return sizes, loose, plain


_UNIT_KEY = re.compile(r"^(unit|units|einheit|единица измерения|ед\. ?изм\.?|размеры указаны в)$", re.I)


def stated_unit(text: str | None) -> float | None:
    """Millimetres of the one length unit a remark names; None if it names none or several."""
    found = set()
    for word in re.findall(r"[^\W\d_]+", _clean(text or "")):
        u = parse_unit(word, "size")
        # short words are units only where the remark ends with them ("в см", "in mm")
        if u and u.dimension == "length" and u.exponent == 1 and word.lower() not in ("in", "в", "с"):
            found.add(u.factor * 1000)
    return found.pop() if len(found) == 1 else None


def _name_sizes(name: str | None) -> list[float]:
    if not name:
        return []
    t = _clean(name)
    out = [mm for n, u in re.findall(rf"({_NUM})\s*([^\W\d_]+)", t) if (mm := to_mm(_value(n), u)) is not None]
    return out + [_value(n) for n in re.findall(r"\b[WDHØ](\d{2,4})\b", t, re.I)]


def resolve_sizes(dimensions: str | None, columns: dict[str, float | None], mm_columns: dict[str, float | None], unit_mm: float | None, name: str | None = None) -> dict[str, int]:
    """One card's sizes in whole millimetres.

    Order of trust: a unit written in the text; the plain column in the card's or shop's unit; the
    text's numbers in that unit, for axes a column confirms; the ``_mm`` column. A ``_mm`` column
    filled in another metric unit is recognised by the other fields of the card, by the size in
    the name, or, all else missing, by the prior that sizes come in whole centimetres.
    """
    good = lambda v: v is not None and v == v and 0 < v < 1e6
    sizes, loose, plain = parse_dimensions(dimensions)
    mm = {a: v for a, v in mm_columns.items() if good(v)}
    out = {a: v for a, v in sizes.items() if good(v)}
    for axis, v in columns.items():
        if good(v) and axis not in out:
            if unit_mm:
                out[axis] = v * unit_mm
            elif axis in mm:
                out[axis] = mm[axis]
            else:  # unit unknown: the one that gives a likely size of whole centimetres
                likely = [f for f in (1.0, 10.0, 25.4, 1000.0) if 30 <= v * f <= 4000]
                whole = [f for f in likely if abs(v * f / 10 - round(v * f / 10)) < 0.03]
                if likely:
                    out[axis] = v * (whole or likely)[0]
    left = [a for a in mm if a not in out]
    if left:
        ratios = {round(out[a] / v) for a, v in mm.items() if a in out and v} & {1, 10, 1000}
        scale = ratios.pop() if len(ratios) == 1 else None
        texts = [n * unit_mm for n in loose + list(plain.values())] if unit_mm else []
        for axis in left:
            v, s = mm[axis], scale
            near = lambda k: any(abs(x - v * k) <= max(0.6, 0.006 * x) for x in texts)  # noqa: E731,B023
            if texts and not near(1):
                s = next((k for k in (10, 1000) if near(k)), s)
            if s is None and not near(1):
                names = _name_sizes(name)
                if axis != "height":
                    hit = [k for k in (1, 10, 1000) if any(abs(x - v * k) <= 0.02 * x for x in names)]
                    s = hit[0] if hit else None
                    if s is not None and scale is None:
                        scale = s
            out[axis] = v * (s or 1)
        if scale is None:
            # whole centimetres: a value that isn't was written in centimetres or metres
            odd = [mm[a] for a in left if abs(mm[a] / 10 - round(mm[a] / 10)) > 1e-6 or mm[a] < 30]
            if odd and not texts:
                k = 1000 if all(mm[a] < 5 for a in left) else 10
                for axis in left:
                    out[axis] = mm[axis] * k
        else:
            for axis in left:
                if abs(out[axis] - mm[axis]) < 1e-9 and scale != 1:
                    out[axis] = mm[axis] * scale
    return {a: int(v + 0.5) for a, v in out.items() if a in AXES}


def product_sizes(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Width, height and diameter in millimetres of every product: product_id, axis, mm.

    Null texts and columns, NaN and non-positive numbers state nothing; a product without any
    size gives no row; products of unknown shops go by the card alone; repeated rows give one
    row per repetition; other columns are ignored. The shops' table is one row per host.
    """
    axes = list(AXES)

    def units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"supplier": pdf["host"], "_shop_mm": [stated_unit(e) for e in pdf["evidence"]]}).astype({"_shop_mm": "float64"})

    shops = suppliers.select("host", "evidence").dropDuplicates(["host"]).mapInPandas(units, "supplier string, _shop_mm double")
    unit_entry = F.filter(F.map_entries("attributes"), lambda e: F.lower(F.trim(e["key"])).rlike(_UNIT_KEY.pattern))
    rows = products.select("product_id", "supplier", "name", "dimensions", *axes, *[f"{a}_mm" for a in axes], F.try_element_at(F.filter(F.transform(unit_entry, lambda e: e["value"]), lambda v: v.isNotNull()), F.lit(1)).alias("_card"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids, names, mms = [], [], []
            number = lambda c: [None if x != x else x for x in pdf[c].astype("float64")]  # noqa: E731,B023
            cols, mm_cols = {a: number(a) for a in axes}, {a: number(f"{a}_mm") for a in axes}
            for i, (pid, text, card, shop, name) in enumerate(zip(pdf["product_id"], pdf["dimensions"], pdf["_card"], number("_shop_mm"), pdf["name"])):
                unit = (to_mm(1.0, card) if card else None) or shop
                got = resolve_sizes(text, {a: cols[a][i] for a in axes}, {a: mm_cols[a][i] for a in axes}, unit, name)
                for axis, mm in got.items():
                    ids.append(pid), names.append(axis), mms.append(mm)
            yield pd.DataFrame({"product_id": pd.array(ids, dtype="Int64"), "axis": pd.array(names, dtype="object"), "mm": pd.array(mms, dtype="Int64")})

    return rows.join(shops, "supplier", "left").mapInPandas(solve, "product_id bigint, axis string, mm bigint")
