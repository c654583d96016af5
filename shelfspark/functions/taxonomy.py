"""Product families by ordered rules, and how two families relate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Families, in the order of the rules that give them. A rule holds if the text has
# any of ``some`` and, where given, any of ``also``; words in slashes are patterns.
WALL = ("настенный светильник", "nastenn", "wall sconce", "sconce", "bra", r"/(^|[^\p{L}\p{N}_])бра([^\p{L}\p{N}_]|$)/")
RULES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("track_rail", ("шинопровод", "трек-rail", " track rail", "шина трека", "шинная система"), ()),
    ("track_connector", ("коннектор", "соединитель", "угловой соединитель"), ()),
    ("track_power_component", ("блок питания трека", "питание шинопровода", "адаптер питания трека"), ()),
    ("magnetic_track_spot", ("магнит",), ("трек", "спот", "светильник")),
    ("track_linear_module", ("линейный модуль трека", "трековый линейный", "linear module"), ()),
    ("accessory", ("крепеж", "крепёж", "кронштейн", "заглушка", "основание для", "стойка для", "кабель питания", "комплектующие", "аксессуар"), ()),
    ("led_strip", ("светодиодная лента", "led strip", "лента светодиод"), ()),
    ("linear_profile", ("профиль",), ("свет", "led", "линей")),
    ("mirror_light", ("подсветка зеркала", "зеркальный светильник", "mirror light"), ()),
    ("track_spot", ("трековый спот", "трековый светильник", "track spot", "трековый"), ()),
    ("spot", ("точечный", "downlight", "spotlight", " spot", "/spot", "-spot", "встраиваемый спот", "накладной спот"), ()),
    ("linear_fixture", ("линейный светильник", "линейная лампа", "linear fixture"), ()),
    ("linear_fixture", ("линей",), ("светильник",)),
    ("decorative_wall", WALL, ("контур", "овал", "кольцо", "декоратив", "светящаяся форма")),
    ("wall_sconce", WALL, ()),
    ("chandelier", ("многорожков", "многоярусн", "люстра", "chandelier"), ()),
    ("pendant_group", ("группа подвесов", "групповой подвес", "cluster pendant", "подвесная группа"), ()),
    ("pendant_single", ("подвес", "подвесной", "pendant", "suspension"), ()),
    ("accessory", ("аксессуар", "комплектующ", "декор"), ()),
]
#: Families that go together, either way.
COMPATIBLE = [("wall_sconce", "decorative_wall"), ("track_spot", "magnetic_track_spot"), ("track_spot", "spot"), ("linear_profile", "linear_fixture"), ("pendant_single", "pendant_group")]
#: ... and one way only: wanted, offered.
ONE_WAY = [("mirror_light", "wall_sconce"), ("mirror_light", "decorative_wall")]
FAMILIES = sorted({f for f, _, _ in RULES} | {"recessed_downlight", "surface_downlight", "unknown"})


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(w.strip("/")) if w[:1] == w[-1:] == "/" else F.contains(text, F.lit(w)) for w in words])


def classify(text: Column) -> Column:
    """The first rule that holds, in one CASE; 'unknown' if none does or the text is null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    case = None
    for family, some, also in RULES:
        holds = _any(t, some) & _any(t, also) if also else _any(t, some)
        case = F.when(holds, family) if case is None else case.when(holds, family)
    return case.otherwise("unknown")


# The classifier of the evaluation corpus. Rules hold for all texts of a product (title,
# category, address) or for its title and address alone; words in slashes are patterns.
_ACCESSORY = ("accessor", "komplekt", "коннектор", "connector", "шинопровод", "track rail", "zaglus", "заглуш", "крепеж", "adapter", "адаптер")
_PENDANT = ("podvesnoy svetilnik", "podvesnye svetilniki", "svetilniki podvesnyie", "подвесной светильник", "pendant light")
_WALL_LAMP = ("bra ", " bra", "настенн", "wall sconce", "wall lamp", "svetilniki nastenn")
_TRACK = ("trekovyy svetilnik", "trekovye svetilniki", "трековый светильник", "track spot", "track light")
#: (family, texts that hold: all, identity or title, any of, none of).
CONTROLLED: list[tuple[str, tuple[tuple[str, tuple[str, ...]], ...], tuple[str, ...]]] = [
    ("accessory", (("all", _ACCESSORY),), ()),
    ("unknown", (("identity", ("lyustra", "lyustry", "люстра", "люстры", "chandelier", "profil", "профиль", "led strip")),), ()),
    ("pendant_single", (("identity", (*_PENDANT, "spoty podvesnye")),), ()),
    ("decorative_wall", (("all", _WALL_LAMP), ("all", ("dekor", "decor", "bradford"))), ()),
    ("wall_sconce", (("all", _WALL_LAMP),), ()),
    ("pendant_single", (("all", _PENDANT),), ("lyustr", "люстр")),
    ("track_spot", (("all", _TRACK), ("identity", ("spot",))), ()),
    ("track_spot", (("all", _TRACK), ("title", (r"/(^|[^\p{L}\p{N}_])(15|24|36)[ \t\n]*[°г]/",))), ()),
    ("unknown", (("all", _TRACK),), ()),
    ("spot", (("identity", ("/(^| )(spot|spotovyy|спот|споты|спотовый)( |$)/", "directional ceiling")),), ()),
]


def controlled(title: Column, category: Column, url: Column) -> Column:
    """Family by the rules of the evaluation corpus; names and addresses go before categories."""
    plain = lambda *cs: F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cs])), "[^a-z0-9а-яё]+", " "))
    of = {"all": plain(title, category, url), "identity": plain(title, url), "title": F.coalesce(title, F.lit(""))}
    case = None
    for family, some, none in CONTROLLED:
        holds = reduce(lambda a, b: a & b, [_any(of[where], words) for where, words in some])
        holds = holds & ~_any(of["all"], none) if none else holds
        case = F.when(holds, family) if case is None else case.when(holds, family)
    return case.otherwise("unknown")


def sql_controlled(title: str, category: str, url: str) -> str:
    """The same CASE for DuckDB."""
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    test = lambda c, w: f"regexp_matches({c}, {quote(w.strip('/'))})" if w[:1] == w[-1:] == "/" else f"contains({c}, {quote(w)})"
    some_of = lambda c, words: "(" + " OR ".join(test(c, w) for w in words) + ")"
    column = {"all": "a", "identity": "i", "title": "t"}
    plain = lambda *cs: "trim(regexp_replace(lower(concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in cs) + ")), '[^a-z0-9а-яё]+', ' ', 'g'))"
    parts = [f"WHEN {' AND '.join(some_of(column[w], ws) for w, ws in some)}{' AND NOT ' + some_of('a', none) if none else ''} THEN {quote(family)}" for family, some, none in CONTROLLED]
    return f"(SELECT CASE {' '.join(parts)} ELSE 'unknown' END FROM (SELECT {plain(title, category, url)} AS a, {plain(title, url)} AS i, coalesce({title}, '') AS t))"


def relation_table(spark: SparkSession) -> DataFrame:
    """(wanted, offered, relation) of all pairs of families: a lookup for equi-joins."""
    rows = []
    for a in FAMILIES:
        for b in FAMILIES:
            if a == b != "unknown":
                r = "exact"
            elif "unknown" in (a, b):
                r = "unknown"
            elif (a, b) in COMPATIBLE or (b, a) in COMPATIBLE or (a, b) in ONE_WAY:
                r = "compatible"
            else:
                r = "incompatible"
            rows.append((a, b, r))
    return spark.createDataFrame(rows, "wanted string, offered string, relation string")


def sql_classify(text: str) -> str:
    """The same CASE for DuckDB."""
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    test = lambda w: f"regexp_matches(t, {quote(w.strip('/'))})" if w[:1] == w[-1:] == "/" else f"contains(t, {quote(w)})"
    some_of = lambda words: "(" + " OR ".join(map(test, words)) + ")"
    parts = []
    for family, some, also in RULES:
        parts.append(f"WHEN {some_of(some)}" + (f" AND {some_of(also)}" if also else "") + f" THEN {quote(family)}")
    return f"(SELECT CASE {' '.join(parts)} ELSE 'unknown' END FROM (SELECT lower(coalesce({text}, '')) AS t))"
