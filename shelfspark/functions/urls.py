"""URL functions as Column expressions (P10, P11, P28, P34). Addresses that a URL parser would
refuse (blanks, odd signs) are cut by pattern instead, so none becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower case, without www."""
    return F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")


def path(url: Column) -> Column:
    return _part(url, 3)


def canonical(url: Column) -> Column:
    """No fragment, no slashes at the path's end; an empty path is a slash; the query stays."""
    p = F.regexp_replace(path(url), "/+$", "")
    prefix = F.when(_part(url, 1) == "", "").otherwise(F.concat(_part(url, 1), F.lit("://")))
    return F.concat(prefix, _part(url, 2), F.when(p == "", "/").otherwise(p), _part(url, 4))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def category(url: Column) -> Column:
    """The last but one part of the path; null if there is none."""
    parts = path_parts(url)
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))


def sku(url: Column) -> Column:
    """The last thing in the last part of the path that looks like an article number."""
    slug = F.regexp_replace(F.try_element_at(path_parts(url), F.lit(-1)), r"(?i)\.(html?|php)$", "")
    found = F.regexp_extract_all(slug, F.lit(r"[A-Za-zА-Яа-я]{1,10}[-_]?[0-9]{2,}[A-Za-zА-Яа-я0-9_-]*|[0-9]{4,}"), F.lit(0))
    return F.try_element_at(found, F.lit(-1))


# What speaks for a product's address and what against it, as (pattern of the path,
# points), each counted once; every slash gives a point, up to four.
PATH_POINTS = (
    (r"/store/|/product|/tovar|/item|\.html", 6),
    (r"[a-z]{2,}[0-9]{3,}|[0-9]{5,}", 4),
    (r"/about/|/news/|/blog/|/catalog/", -2),
    (r"(/|/catalog|/store)$", -4),
)
# Paths that are no product's, ends of paths that are none's, paths that are one's.
NO_PRODUCT = r"/about/|/news/|/blog/|/article/|/search|/filter"
NO_PAGE = r"(/|\.xml|\.jpg|\.png|\.webp)$"
SURE_PRODUCT = r"(?:/[a-zа-я-]{2,}[0-9]{3,}|/[0-9]{5,})(?:/|$)"
MOST_DEPTH, ENOUGH = 4, 6


def product_score(url: Column) -> Column:
    """How much an address looks like a product page's."""
    p = F.lower(path(url))
    depth = F.least(F.length(F.regexp_replace(p, "[^/]+", "")), F.lit(MOST_DEPTH))
    return sum((p.rlike(pattern).cast("int") * points for pattern, points in PATH_POINTS), depth).cast("bigint")


def is_product(url: Column) -> Column:
    """Whether an address may be a product page's."""
    p = F.lower(path(url))
    refused = F.coalesce(F.nullif(p.rlike(NO_PRODUCT), F.lit(False)), p.rlike(NO_PAGE))
    return F.when(refused, F.lit(False)).otherwise((product_score(url) >= ENOUGH) | p.rlike(SURE_PRODUCT))


def host_suffixes(h: Column) -> Column:
    """A host and all its parent domains, longest first; turns a suffix test into an equi-join."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def contains_sku(url: Column, sku_: Column) -> Column:
    """Whether the normalised address holds the normalised article number."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-zа-яё]+", "")
    return (squeeze(sku_) != "") & F.contains(squeeze(url), squeeze(sku_))


def selected(rows: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """Rows and ``selected``: whether the path of an address matches the pattern of its host; of
    ``rules`` (suffix, pattern) the one of the longest suffix of the host holds, none selects none.
    Rows that are equal in all columns stay as many as they are."""
    keyed = rows.withColumn("_id", F.monotonically_increasing_id())
    parts = keyed.select("_id", path(F.col(url)).alias("_path"), F.posexplode(host_suffixes(host(F.col(url)))).alias("_n", "suffix"))
    best = parts.join(rules, "suffix").groupBy("_id").agg(F.min_by(F.struct("_path", "pattern"), "_n").alias("_r"))
    return keyed.join(best, "_id", "left").withColumn("selected", F.coalesce(F.expr("_r._path rlike _r.pattern"), F.lit(False))).drop("_id", "_r")
