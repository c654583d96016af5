"""Queries of the problems tagged llm, p3 to p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import boilerplate, bpe, listings, mojibake, packing, topn, unify, vocabulary
from shelfspark.session import cut_lineage, spread, table


#: Field to (list of the reference table, is the value a path).
FREE_FIELDS = {"category": ("category", True), "availability_status": ("availability", False), "availability_source_text": ("availability", False)}
#: Field to whether it is a code.
UNIFIED_FIELDS = {"sku": True, "name": False}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = spread(table(spark, sf_dir, "catalog_products"))
    described = boilerplate.boilerplate_lines(products, "product_id", "supplier", "description").withColumn("field_name", F.lit("description"))
    sure = vocabulary.statements(table(spark, sf_dir, "reference_values"), "availability")
    stated = boilerplate.other_lines(products, "product_id", "supplier", "availability_source_text", sure).withColumn("field_name", F.lit("availability_source_text"))
    return described.unionByName(stated).select("product_id", "field_name", "line_no")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with its group."""
    return listings.groups(spread(table(spark, sf_dir, "catalog_products")), table(spark, sf_dir, "supplier_capability"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.pairs_of(p4_groups(spark, sf_dir))


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index held against brute force."""
    read = cut_lineage(listings.listing_features(spread(table(spark, sf_dir, "catalog_products")), table(spark, sf_dir, "supplier_capability")))
    found = cut_lineage(listings.complete(read))
    index = listings.fit(found, found.count())
    vectors = cut_lineage(listings.encode(found, index))
    return listings.recall(cut_lineage(listings.with_lists(vectors, listings.check_probes(vectors, index))))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.unify_fields(spread(table(spark, sf_dir, "catalog_products")), "product_id", UNIFIED_FIELDS).filter("changed").select("product_id", "field_name")


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields in their consistent form, and the form to compare by."""
    return unify.unify_fields(spread(table(spark, sf_dir, "catalog_products")), "product_id", UNIFIED_FIELDS).select("product_id", "field_name", "unified", "compared", "changed")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.map_values(spread(table(spark, sf_dir, "catalog_products")), "product_id", FREE_FIELDS, table(spark, sf_dir, "reference_values"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "scored_candidates"))
    return topn.top_n(rows, "requirement_id", "overall_score", "product_id", "candidate_id", 5).select(
        "requirement_id", F.col("rank_no").cast("long").alias("rank_no"), "candidate_id"
    )


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bpe.count_tokens(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore(spread(table(spark, sf_dir, "documents")), "doc_id", "text").filter("n_garbled > 0").select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with what could be regained of their text."""
    return mojibake.restore(spread(table(spark, sf_dir, "documents")), "doc_id", "text").filter("n_garbled > 0")


QUERIES = {
    "p3_found": p3_found, "p4_found": p4_found, "p4_groups": p4_groups, "p4_recall": p4_recall, "p5_found": p5_found, "p5_unified": p5_unified, "p6_found": p6_found,
    "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_restored": p10_restored,
}

ORACLE = {
    "p7_found": """WITH r AS (SELECT * FROM scored_candidates WHERE requirement_id IS NOT NULL AND overall_score IS NOT NULL AND NOT isnan(overall_score)),
p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY requirement_id, product_id ORDER BY overall_score DESC, candidate_id) = 1),
k AS (SELECT requirement_id, candidate_id, row_number() OVER (PARTITION BY requirement_id ORDER BY overall_score DESC, candidate_id) AS rank_no FROM p)
SELECT requirement_id, rank_no, candidate_id FROM k WHERE rank_no <= 5""",
}
