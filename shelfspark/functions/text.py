"""Text functions as Column expressions.

Letters and digits are Unicode classes in both Spark and the SQL they are compared with; plain
``\\w`` means ASCII in Java.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def truthy(c: Column) -> Column:
    """Null where a text is null or empty."""
    return F.when(c != "", c)


def tokens(c: Column) -> Column:
    """Distinct lower-case words in order of appearance; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0)))


def attribute_text(attributes: Column) -> Column:
    """Entries of a map as "key value", by key."""
    entries = F.array_sort(F.map_entries(attributes))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")


def joined(columns: list[Column], separator: str = " ") -> Column:
    """The non-empty texts, joined."""
    return F.concat_ws(separator, *[truthy(c) for c in columns])


def record_text(columns: list[Column]) -> Column:
    """All texts, null as empty, lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


def sku_key(c: Column) -> Column:
    """Letters of Latin and Russian and digits only."""
    return F.regexp_replace(F.lower(c), "[^0-9a-zа-яё]+", "")


def alnum_key(c: Column) -> Column:
    """Letters and digits of any script only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def word_key(c: Column) -> Column:
    """As ``alnum_key``, underscores kept."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")


def spaced_key(c: Column) -> Column:
    """Words parted by single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def clean_blank(c: Column) -> Column:
    """Non-breaking spaces as blanks, runs collapsed, empty as null."""
    return truthy(F.trim(F.regexp_replace(F.regexp_replace(c, " ", " "), r"\s+", " ")))


def strip_tags(c: Column) -> Column:
    """P5 without entities: tags as blanks, runs of blanks collapsed, empty as null."""
    return truthy(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")))


def first_number(c: Column) -> Column:
    """The first number with at most one separator in it; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(c, " ", " "), r"[0-9]+(?:[\s.,][0-9]+)?", 0)
    return F.regexp_replace(F.regexp_replace(found, r"\s", ""), ",", ".").try_cast("double")


def first_integer(c: Column) -> Column:
    """The first run of digits."""
    return F.regexp_extract(c, r"[0-9]+", 0).try_cast("bigint")


def dimension_mm(c: Column) -> Column:
    """The first number of a text in millimetres; without a unit it is in millimetres."""
    pattern = r"(?i)([0-9]+(?:[\s.,][0-9]+)?)\s*(мм|mm|см|cm|м|m)?(?:[^\p{L}\p{N}_]|$)"
    number = first_number(F.regexp_extract(c, pattern, 1))
    unit = F.lower(F.regexp_extract(c, pattern, 2))
    return number * F.when(unit.isin("см", "cm"), 10).when(unit.isin("м", "m"), 1000).otherwise(1)


def sha_id(columns: list[Column], length: int = 16) -> Column:
    """First characters of the SHA-256 of the texts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, length)


def offer_price(c: Column) -> Column:
    """The first number of an offer's text, blanks between its digits left out, a comma for the point."""
    found = F.regexp_extract(c, r"[0-9][0-9 \t\n\r\f]*(?:[,.][0-9]{1,3})?", 0)
    return F.replace(F.regexp_replace(found, r"[ \t\n\r\f]+", ""), F.lit(","), F.lit(".")).try_cast("double")
