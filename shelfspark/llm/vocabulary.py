"""Mapping free-entered values to a list of canonical entries.

An automaton over all canonical names and aliases finds those embedded in a value; of the matches
the longest that don't overlap win. What no alias covers goes to token-set similarity, where
tokens may be misspelt by a letter or two, cut short with a dot, or in another order. Values that
stay below the threshold are reported as meaning no entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.unify import unify

NONE = "none"
#: Least similarity of the tokens of a value and of an alias.
SIMILAR = 0.74

#: Other names of the entries than the list's own labels and codes, Russian, English and German.
ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "category": {
        "pendant_single": ("подвес", "подвесы", "светильник подвесной", "pendant light", "pendant lamp", "hanging lamps", "hanging lamp", "suspended lights", "suspended light", "pendelleuchte", "pendelleuchten", "hängeleuchte", "hängeleuchten"),
        "chandelier": ("люстра", "люстры каскадные", "потолочная люстра", "люстра потолочная", "chandelier", "chandelier lamp", "ceiling chandelier", "kronleuchter"),
        "wall_sconce": ("бра", "бра настенные", "настенные светильники", "настенный светильник", "wall sconce", "wall lamps", "wall lamp", "wall lights", "sconces", "wandleuchte", "wandleuchten"),
        "spot": ("спот", "споты поворотные", "спот поворотный", "spot lamps", "spot lamp", "spotlight", "spots", "spot", "strahler"),
        "recessed_downlight": ("светильник встраиваемый", "встройка точечная", "встраиваемые точечные", "built-in downlights", "built-in downlight", "recessed downlight", "recessed lights", "einbauleuchte", "einbauleuchten", "einbaustrahler"),
        "surface_downlight": ("светильник накладной", "накладные точечные", "surface mounted downlights", "surface mounted downlight", "surface downlight", "aufbauleuchte", "aufbauleuchten", "aufbaustrahler"),
        "track_spot": ("светильник трековый", "трековые прожекторы", "трековый прожектор", "track spotlight", "track spotlights", "track light", "schienenstrahler"),
        "linear_fixture": ("светильник линейный", "линейный свет", "linear luminaires", "linear luminaire", "linear light", "linienleuchte", "linienleuchten"),
        "mirror_light": ("подсветка зеркала", "подсветка для зеркала", "светильник для зеркала", "светильники для зеркал", "mirror light", "vanity mirror lamps", "mirror lamps", "spiegelleuchte", "spiegelleuchten"),
        "floor_lamp": ("торшер", "напольные светильники", "напольный светильник", "standing lamps", "standing lamp", "floor lamp", "stehleuchte", "stehleuchten", "stehlampe"),
        "table_lamp": ("настольный светильник", "настольные светильники", "лампа настольная", "desk lamps", "desk lamp", "table lamp", "tischleuchte", "tischleuchten", "tischlampe"),
        "outdoor_light": ("светильник уличный", "фонари для сада", "садовые фонари", "garden lights", "garden light", "outdoor light", "außenleuchte", "außenleuchten"),
        "linear_profile": ("профиль алюминиевый", "профиль для ленты", "профили", "aluminium profile", "aluminium profiles", "led profile", "alu profil"),
        "led_strip": ("лента светодиодная", "светодиодная лента", "led tape", "led strip", "led band", "led streifen"),
        "track_rail": ("шинопровод", "track rail", "трек шинопровод", "stromschiene", "stromschienen"),
        "track_power_component": ("блок питания", "драйвер", "led driver", "power supply", "netzteil", "netzteile"),
        "track_connector": ("коннектор", "соединители и коннекторы", "соединители", "connector", "verbinder"),
        "accessory": ("аксессуары", "аксессуар", "запчасти", "запасные плафоны", "запасной плафон", "accessory", "accessories", "spare shades", "spare shade", "spare parts", "zubehör", "ersatzteile", "ersatzschirm"),
        "bulb": ("лампочка", "лампы сменные", "сменные лампы", "replacement bulbs", "light bulb", "bulbs", "leuchtmittel", "glühbirne"),
        "picture_light": ("подсветка картин", "подсветка для картины", "светильник для картины", "светильники для картин", "picture light", "picture lamps", "bilderleuchte", "bilderleuchten"),
    },
    "availability": {
        "in_stock": ("в наличии", "есть в наличии", "есть на складе", "много на складе", "на складе", "# шт в наличии", "в наличии # шт", "остаток #", "остаток # шт", "осталось # шт", "available", "available ships in # days", "in stock # pcs", "instock", "auf lager", "sofort lieferbar", "lieferbar", "отгрузка сегодня"),
        "out_of_stock": ("outofstock", "sold out", "not in stock", "currently not in stock", "not available", "unavailable", "нет на складе", "распродан", "товар распродан", "закончился", "временно отсутствует", "отсутствует", "остаток 0", "остаток 0 шт", "осталось 0 шт", "0 шт", "0 шт на складе", "0 шт в наличии", "в наличии 0 шт", "на складе 0", "in stock 0 pcs", "nicht auf lager", "nicht lieferbar", "ausverkauft", "temporarily unavailable"),
        "discontinued": ("снят с пр ва", "снят с производства", "снята с производства", "выведен из ассортимента", "архивная модель", "больше не производится", "не производится", "no longer produced", "auslaufmodell", "auslaufmodell nicht mehr lieferbar", "nicht mehr lieferbar", "end of life"),
        "preorder": ("preorder", "pre order", "предзаказ", "только под заказ", "под заказ # дней", "на заказ", "на заказ срок # недель", "made to order", "made to order # weeks", "vorbestellung", "auf bestellung"),
        "expected": ("ожидается", "ожидаем поступление", "скоро в продаже", "скоро поступит", "скоро поступление", "в пути", "в пути поступление #", "coming soon", "expected in week #", "wird erwartet", "wird erwartet am #", "в ожидании"),
        "check_availability": ("уточняйте", "уточните у менеджера", "наличие уточняется", "наличие по запросу", "по запросу", "checkavailability", "availability on request", "on request", "auf anfrage", "уточните наличие"),
        "unknown": ("неизвестно", "данных нет", "no data", "unknown", "keine daten", "нет информации"),
    },
}

_TRANSLIT = dict(zip("абвгдезийклмнопрстуфхцыэёъь", ("a", "b", "v", "g", "d", "e", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "y", "e", "e", "", ""))) | {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya"}
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}#.]+")
_PATH = regex.compile(r"\s*[>/»›→\\|]\s*|\s::\s")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")


def transliterate(text: str) -> str:
    return "".join(_TRANSLIT.get(c, c) for c in text)


def _plain(text: str, keep_dots: bool = False) -> str:
    """Unified, folded, numbers as # (zero stays), words parted by one blank."""
    t = unify(text).casefold().replace("ё", "е")
    t = _NOT_WORD.sub(" ", t)
    t = regex.sub(r"\d[\d.]*", lambda m: "0" if not m[0].strip("0.") else "#", t)
    t = regex.sub(r"#(?:[ .]#)+", "#", t)
    if not keep_dots:
        t = t.replace(".", " ")
    return " ".join(t.split())


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, given up beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return last[-1]


class Matcher:
    """Maps values to one list's entries; ``names`` holds (entry, name) pairs."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.aliases: dict[str, str] = {}
        for code, name in names:
            plain = _plain(name)
            if plain:
                self.aliases.setdefault(plain, code)
                self.aliases.setdefault(transliterate(plain), code)
        self.automaton = ahocorasick.Automaton()
        for alias, code in self.aliases.items():
            self.automaton.add_word(f" {alias} ", (len(alias), code))
        if self.aliases:
            self.automaton.make_automaton()
        self.sets = [(alias.split(), code) for alias, code in self.aliases.items()]
        #: Where each word stands; words by their length, and by their first three letters.
        self.of_word: dict[str, list[int]] = {}
        for i, (tokens, _) in enumerate(self.sets):
            for w in dict.fromkeys(tokens):
                self.of_word.setdefault(w, []).append(i)
        self.of_size: dict[int, list[str]] = {}
        self.of_start: dict[str, list[str]] = {}
        for w in sorted(self.of_word):
            self.of_size.setdefault(len(w), []).append(w)
            self.of_start.setdefault(w[:3], []).append(w)
        self.near: dict[str, dict[str, float]] = {}
        self.done: dict[tuple[str, bool], str] = {}
        self.lines: dict[str, tuple[int, float]] = {}

    def _embedded(self, plain: str) -> tuple[int, str] | None:
        """Entry of the longest match; all matches that don't overlap must agree or be shorter."""
        if not self.aliases:
            return None
        found = [(size + 2, end, code) for end, (size, code) in self.automaton.iter(f" {plain} ")]
        taken: list[tuple[int, int, str, int]] = []
        for size, end, code in sorted(found, key=lambda x: (-x[0], x[1])):
            start = end - size
            if all(end <= s or start >= e for s, e, _, _ in taken):
                taken.append((start, end, code, size))
        return max(((size, code) for _, _, code, size in taken), key=lambda x: x[0], default=None)

    def _similar_words(self, token: str) -> dict[str, float]:
        """Words of the aliases this token may stand for, with how sure that is."""
        got = self.near.get(token)
        if got is None:
            got = {}
            cut = token.endswith(".")
            bare = token.strip(".")
            if cut and len(bare) >= 3:
                got |= {w: 0.95 for w in self.of_start.get(bare[:3], ()) if w.startswith(bare)}
            n = len(bare)
            for size in range(max(4, n - 2), n + 3) if n >= 4 else ():
                most = 1 if min(n, size) < 8 else 2
                for w in self.of_size.get(size, ()) if abs(size - n) <= most else ():
                    if w not in got and (d := edits(bare, w, most)) <= most:
                        got[w] = 1.0 - d / max(n, size)
            if n == 3:
                got |= {w: 0.8 for w in self.of_size.get(3, ()) if sorted(bare) == sorted(w)}
            if bare in self.of_word:
                got[bare] = 1.0
            if len(self.near) > 50_000:
                self.near.clear()
            self.near[token] = got
        return got

    def _closest(self, plain: str) -> tuple[float, str, int] | None:
        """Best token-set similarity (matched weight over the tokens of both, long words more),
        its entry and the length of its alias."""
        tokens = plain.split()
        if not tokens:
            return None
        near = [self._similar_words(t) for t in tokens]
        possible = {w for n in near for w in n}
        if not possible:
            return None
        size = sum(len(t.strip(".")) for t in tokens)
        best = None
        for at in sorted({i for w in possible for i in self.of_word[w]}):
            alias, code = self.sets[at]
            used: set[int] = set()
            matched = 0.0
            for w in alias:
                best_at = max((i for i in range(len(tokens)) if i not in used and w in near[i]), key=lambda i: near[i][w], default=None)
                if best_at is not None:
                    used.add(best_at)
                    matched += near[best_at][w] * len(w)
            whole = sum(map(len, alias))
            extra = size - sum(len(tokens[i].strip(".")) for i in used)
            score = matched / (whole + extra) if whole + extra else 0.0
            if best is None or score > best[0]:
                best = (score, code, len(" ".join(alias)))
        return best

    def _one(self, text: str) -> tuple[int, float, str]:
        """(how it was found: 2 embedded, 1 similar, 0 not), strength, entry.

        An embedded name that leaves words over gives way to a longer name that is similar to the
        whole ("trck spotlight" means track spotlights, not spotlights).
        """
        plain = _plain(text)
        split = _plain(_CAMEL.sub(" ", text.replace("_", " ")))
        exact = self._embedded(plain) or (self._embedded(split) if split != plain else None)
        if exact and exact[0] - 2 >= len(plain):
            return 2, exact[0], exact[1]
        best = max((b for b in (self._closest(_plain(text, keep_dots=True)), self._closest(split)) if b), default=None)
        if exact and (best is None or best[0] < 0.8 or best[2] + 2 <= exact[0]):
            return 2, exact[0], exact[1]
        if best and best[0] >= SIMILAR:
            return 1, best[0], best[1]
        return 0, 0.0, NONE

    def line(self, text: str) -> tuple[int, float]:
        """How surely a line states an entry; (0, 0.0): not at all."""
        got = self.lines.get(text)
        if got is None:
            if len(self.lines) > 200_000:
                self.lines.clear()
            got = self.lines[text] = self._one(text)[:2] if text.strip() else (0, 0.0)
        return got

    def match(self, value: str, path: bool = False) -> str:
        """The entry meant by a value; of several lines the best decides, of a path its last step."""
        key = (value, path)
        got = self.done.get(key)
        if got is None:
            lines = [x for x in value.split("\n") if x.strip()]
            if path and lines:
                steps = [x for x in _PATH.split(lines[-1]) if x.strip()]
                lines = steps[-1:]
            got = max((self._one(x) for x in lines), key=lambda x: x[:2], default=(0, 0.0, NONE))[2]
            if len(self.done) > 200_000:
                self.done.clear()
            self.done[key] = got
        return got


Aliases = dict[str, dict[str, tuple[str, ...]]] | DataFrame | None
#: Most rows of a list, or of its aliases, that are sent to every worker.
MOST_NAMES = 100_000


def _short(table: DataFrame) -> list:
    """The rows of a list kept by people; refused beyond ``MOST_NAMES``."""
    rows = table.limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError("the list is longer than a list that is sent to every worker may be")
    return rows


def _names(reference: DataFrame, aliases: Aliases) -> dict[str, list[tuple[str, str]]]:
    """(entry, name) pairs of every list: codes, labels and aliases. Aliases are a table
    (list_name, ref_code, alias) or nested by list and entry; None: ``ALIASES``."""
    entries = _short(reference.select("list_name", "ref_code", "label_ru", "label_en"))
    if isinstance(aliases, DataFrame):
        more: dict[str, dict[str, tuple[str, ...]]] = {}
        for r in sorted(_short(aliases.select("list_name", "ref_code", "alias")), key=lambda r: (r["list_name"] or "", r["ref_code"] or "", r["alias"] or "")):
            of = more.setdefault(r["list_name"], {})
            of[r["ref_code"]] = (*of.get(r["ref_code"], ()), r["alias"])
        aliases = more
    aliases = ALIASES if aliases is None else aliases
    names: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(entries, key=lambda r: (r["list_name"] or "", r["ref_code"] or "")):
        if r["ref_code"]:
            own = [r["ref_code"], r["ref_code"].replace("_", " "), r["label_ru"], r["label_en"], *aliases.get(r["list_name"], {}).get(r["ref_code"], ())]
            names.setdefault(r["list_name"], []).extend((r["ref_code"], n) for n in own if n)
    return names


def statements(reference: DataFrame, list_name: str, aliases: Aliases = None) -> Callable[[], Callable[[str], float]]:
    """Makes, in a task, a function that says how surely a line states an entry of the list; 0.0:
    not at all, up to 1: similar, above: embedded."""
    names = _names(reference, aliases).get(list_name, [])

    def make() -> Callable[[str], float]:
        matcher = Matcher(names)
        return lambda line: float(matcher.line(line)[1])

    return make


def map_values(rows: DataFrame, key: str, fields: dict[str, tuple[str, bool]], reference: DataFrame, aliases: Aliases = None) -> DataFrame:
    """key, field_name, ref_code for every non-null value of ``fields`` (column to: list, path).

    ``reference`` (list_name, ref_code, label_ru, label_en) is a short list kept by people; it is
    sent to the workers and refused beyond 100,000 rows. Null values give no row, empty and blank
    ones mean no entry; unmatched values get ``none``; ties go to the first alias; repeated rows
    repeat; other columns are ignored.
    """
    names = _names(reference, aliases)
    kind = rows.schema[key].dataType.simpleString()
    columns = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {n: Matcher(names.get(n, [])) for n, _ in fields.values()}
        for batch in batches:
            for i, name in enumerate(columns, 1):
                column = batch.column(i)
                keep = column.is_valid()
                keys, coded = batch.column(0).filter(keep), column.filter(keep).dictionary_encode()
                matcher, path = matchers[fields[name][0]], fields[name][1]
                codes = pa.array([matcher.match(v, path) for v in coded.dictionary.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([keys, pa.array([name] * len(keys), pa.string()), codes.take(coded.indices)], ["k", "field_name", "ref_code"])

    out = rows.select(F.col(key).alias("k"), *columns).mapInArrow(run, f"k {kind}, field_name string, ref_code string")
    return out.withColumnRenamed("k", key)
