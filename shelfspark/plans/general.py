"""Queries of the problems tagged general: p1 (history) and p2 (units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.times import instant_micros
from shelfspark.operators.history import ledger, versions
from shelfspark.operators.units import product_sizes
from shelfspark.session import spread, table


def product_ledger(updates: DataFrame) -> DataFrame:
    """Ledger of status and price per product. Letter case and blanks around a status don't
    matter, prices are held to 2 decimals, NaN counts as null."""
    price = F.when(~F.isnan("price"), F.round("price", 2))
    return ledger(
        updates.select("product_id", instant_micros(F.col("availability_checked_at")).alias("at"), "load_seq", F.lower(F.trim("availability_status")).alias("status"), price.alias("price")),
        "product_id", "at", "load_seq", ["status", "price"],
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = product_ledger(table(spark, sf_dir, "product_updates"))
    return versions(held, "product_id", ["status", "price"]).select("product_id", F.floor(F.col("valid_from") / 1_000_000).cast("long").alias("valid_from_s"))


def p1_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ledger, superseded rows included."""
    return product_ledger(table(spark, sf_dir, "product_updates"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_sizes(spread(table(spark, sf_dir, "catalog_products")), table(spark, sf_dir, "supplier_capability"))


QUERIES = {"p1_found": p1_found, "p1_ledger": p1_ledger, "p2_found": p2_found}

_INSTANT = """CASE WHEN regexp_full_match(trim(availability_checked_at), '[+-]?[0-9]+(\\.[0-9]+)?')
 THEN CAST(CAST(trim(availability_checked_at) AS DECIMAL(20,6)) * 1000000 AS BIGINT)
 WHEN regexp_matches(trim(availability_checked_at), '(?i)(z|[+-][0-9]{2}:?[0-9]{2})$') THEN epoch_us(CAST(trim(availability_checked_at) AS TIMESTAMPTZ))
 ELSE epoch_us(CAST(trim(availability_checked_at) || 'Z' AS TIMESTAMPTZ)) END"""

ORACLE = {
    "p1_found": f"""WITH o AS (SELECT product_id, load_seq, {_INSTANT} AS ts, lower(trim(availability_status)) AS status,
 CASE WHEN isnan(price) THEN NULL ELSE round(price, 2) END AS price FROM product_updates WHERE availability_checked_at IS NOT NULL),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY product_id, ts ORDER BY load_seq DESC) = 1),
g AS (SELECT *, lag(status) OVER w AS ps, lag(price) OVER w AS pp, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY product_id ORDER BY ts))
SELECT product_id, CAST(floor(ts / 1000000) AS BIGINT) AS valid_from_s FROM g WHERE n = 1 OR status IS DISTINCT FROM ps OR price IS DISTINCT FROM pp""",
}
