"""How well a requirement and a product agree, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import tokens

# Words of one colour.
COLOUR_GROUPS: dict[str, tuple[str, ...]] = {
    "черный": ("черный", "чёрный", "black", "антрацит", "графит", "венге"),
    "белый": ("белый", "white", "молочный"),
    "золотой": ("золотой", "золото", "gold", "латунь", "brass"),
    "серый": ("серый", "grey", "gray"),
    "коричневый": ("коричневый", "венге", "brown"),
    "хром": ("хром", "chrome", "серебро", "серебристый"),
}
COLOUR_SCORES = {"not_required": 0.55, "unknown": 0.40, "match": 1.0, "mismatch": 0.0}


def field_match(wanted: Column, offered: Column) -> Column:
    """Share of the wanted words that are offered, a little raised; 0.55 if none is wanted,
    0.25 if none is offered."""
    w, o = tokens(wanted), tokens(offered)
    share = F.size(F.array_intersect(w, o)) / F.size(w) * 1.15
    return F.when(F.size(w) == 0, F.lit(0.55)).when(F.size(o) == 0, F.lit(0.25)).otherwise(F.least(F.lit(1.0), share))


def colour_keys(c: Column) -> Column:
    words = tokens(c)
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, group))), key) for key, group in COLOUR_GROUPS.items()]))


def colour_relation(wanted: Column, offered: Column) -> Column:
    """not_required, unknown, match or mismatch."""
    w, o = colour_keys(wanted), colour_keys(offered)
    return F.when(F.size(w) == 0, "not_required").when(F.size(o) == 0, "unknown").when(F.size(F.array_intersect(w, o)) > 0, "match").otherwise("mismatch")


def dimension_match(wanted: Column, offered: dict[str, Column]) -> Column:
    """Mean closeness of the wanted dimensions (a map of millimetres); 0.55 if none is
    wanted, 0.35 for one the product doesn't state."""
    entries = F.filter(F.map_entries(wanted), lambda e: e["value"].isNotNull())

    def close(e: Column) -> Column:
        name = F.regexp_replace(e["key"], "_mm$", "")
        actual = F.coalesce(*[F.when(name == k, c) for k, c in offered.items()])
        delta = F.abs(actual - e["value"]) / F.greatest(e["value"], F.lit(1.0))
        return F.when(actual.isNull(), F.lit(0.35)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.least(delta, F.lit(1.0))))

    scores = F.transform(entries, close)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when(wanted.isNull() | (F.size(wanted) == 0), F.lit(0.55)).when(F.size(entries) == 0, F.lit(0.45)).otherwise(mean)


def ip_level(c: Column) -> Column:
    """P25: the protection class a text names."""
    return F.regexp_extract(c, r"(?i)\bIP\s*([0-9]{2})\b", 1).try_cast("int")


def technical_status(constraints: Column, rating: Column) -> Column:
    """P25: whether the product's protection class meets the constraints."""
    text = F.lower(F.array_join(constraints, " "))
    needed, have = ip_level(F.array_join(constraints, " ")), ip_level(rating)
    return (
        F.when(~text.rlike("влажн|сануз|ip") | constraints.isNull(), "not_required")
        .when(have.isNull(), "requires_ip_check").when(have < needed, "explicit_mismatch").otherwise("verified")
    )
