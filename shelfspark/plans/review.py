"""Queries of the index, of review and of the benchmark as a whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shelfspark.functions import taxonomy, text
from shelfspark.operators import index, pages, ranking
from shelfspark.plans.base import Registry
from shelfspark.plans.catalog import _UPSERT, inventory_upsert
from shelfspark.plans.functions import _PATH, TOKENS
from shelfspark.session import shared_dir, table
from shelfspark.streaming.upserts import fresh

query = Registry()

DIM = 64


# The index -------------------------------------------------------------------------------------
def _encode(images: list[str]) -> np.ndarray:
    """Stands for an image encoder: a vector made of the address."""
    return np.array([[float(ord(c)) for c in x[-DIM:].rjust(DIM)] for x in images]).reshape(len(images), DIM)


def _images(spark, d):
    return index.image_rows(table(spark, d, "catalog_products"), "product_id", F.col("image_urls"), F.col("primary_image_url"), 3)


def _cache(spark, d):
    """Vectors of some products' first images; every tenth broken off, every seventh of an older version."""
    first = table(spark, d, "catalog_products").select(F.col("product_id").alias("vec_id"), F.try_element_at("image_urls", F.lit(1)).alias("image")).filter("image is not null")
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).join(first, "vec_id")
    vector = F.when(F.col("vec_id") % 10 == 0, F.slice("v", 1, 5)).otherwise(F.col("v"))
    return e.select(F.lit("m").alias("model"), F.when(F.col("vec_id") % 7 == 0, "v1").otherwise("v2").alias("version"), F.sha2("image", 256).alias("hash"), vector.alias("vector"))


_ROWS = """SELECT product_id, CAST(p AS BIGINT) AS position, image_urls[p] AS image FROM catalog_products, (SELECT unnest([1, 2, 3]) AS p) WHERE p <= len(image_urls)
UNION ALL SELECT product_id, 1, primary_image_url FROM catalog_products WHERE coalesce(len(image_urls), 0) = 0 AND primary_image_url IS NOT NULL"""
_SOUND = "SELECT sha256(p.image_urls[1]) AS hash FROM embeddings e JOIN catalog_products p ON p.product_id = e.vec_id WHERE e.vec_id % 10 <> 0 AND e.vec_id % 7 <> 0 AND p.image_urls[1] IS NOT NULL"


@query("r5_index", f"WITH r AS ({_ROWS}) SELECT product_id, position, sha256(image) AS image_hash, sha256(image) IN ({_SOUND}) AS from_cache, {DIM} AS dim FROM r")
def build_index(spark, d):
    """One row per image, the primary one where there is no other; only what the cache lacks is encoded."""
    got = index.build(_images(spark, d), _cache(spark, d), _encode, "m", "v2", DIM, fresh(shared_dir(spark)))
    return got.select("product_id", "position", "image_hash", "from_cache", F.size("vector").alias("dim"))


@query("r6_cache", f"WITH r AS ({_ROWS}) SELECT DISTINCT sha256(image) AS hash, true AS from_cache FROM r")
def mended_cache(spark, d):
    """A second build over the cache the first one wrote encodes nothing."""
    path = fresh(shared_dir(spark))
    index.build(_images(spark, d), _cache(spark, d), _encode, "m", "v2", DIM, path)
    return index.build(_images(spark, d), index.load_cache(spark, path), _encode, "m", "v2", DIM, f"{path}/again").select(F.col("image_hash").alias("hash"), "from_cache").distinct()


@query("s18_load_index", f"WITH r AS ({_ROWS}) SELECT product_id, count(*) AS images, {DIM} AS dim FROM r GROUP BY product_id")
def load_index(spark, d):
    path = fresh(shared_dir(spark))
    index.build(_images(spark, d), _cache(spark, d), _encode, "m", "v2", DIM, path)
    return index.load(spark, path).groupBy("product_id").agg(F.count("*").alias("images"), F.min(F.size("vector")).alias("dim"))


@query("r4_retrieval_status", """SELECT id AS requirement_id, CASE WHEN NOT EXISTS (SELECT 1 FROM embeddings) THEN 'empty_index' WHEN coalesce(len(reference_crop_paths), 0) = 0 AND coalesce(len(reference_image_paths), 0) = 0 THEN 'no_query_images'
WHEN trim(coalesce(visual_description, '')) = '' THEN 'no_text' ELSE 'ready' END AS status FROM requirements""")
def retrieval_status(spark, d):
    """Why a requirement can't be searched for; an error is a row, not an end of the job."""
    empty = table(spark, d, "embeddings").isEmpty()
    images = F.coalesce(F.size("reference_crop_paths"), F.lit(0)) + F.coalesce(F.size("reference_image_paths"), F.lit(0))
    status = F.when(F.lit(empty), "empty_index").when(images <= 0, "no_query_images").when(F.trim(F.coalesce("visual_description", F.lit(""))) == "", "no_text").otherwise("ready")
    return table(spark, d, "requirements").select(F.col("id").alias("requirement_id"), status.alias("status"))


# Scans and joins -------------------------------------------------------------------------------
@query("s6_inventory_scan", f"SELECT supplier, canonical_url, sku, row_number() OVER (PARTITION BY supplier ORDER BY canonical_url) AS place FROM ({_UPSERT}) WHERE supplier IN ('lampovik.example', 'fonarium.example')")
def inventory_scan(spark, d):
    """The stored inventory of some suppliers, in order."""
    i = inventory_upsert(spark, d).filter(F.col("supplier").isin("lampovik.example", "fonarium.example")).select("supplier", "canonical_url", "sku")
    return ranking.top_k(i, ["supplier"], [F.col("canonical_url")], 2**31 - 1, "place")


@query("j2_gated_products", f"""WITH r AS (SELECT id AS requirement_id, taxonomy_family AS wanted, {TOKENS.format("concat_ws(' ', fixture_type, visual_description, color)")} AS a FROM requirements WHERE CAST(regexp_extract(id, '[0-9]+') AS BIGINT) % 100 = 0),
p AS (SELECT product_id, product_family AS offered, {TOKENS.format('name')} AS b FROM catalog_products WHERE product_family IS NOT NULL),
g AS (SELECT requirement_id, product_id, wanted = offered AS exact, len(list_intersect(a, b)) AS shared FROM r JOIN p ON wanted <> 'unknown' AND wanted = offered OR (wanted, offered) IN ({', '.join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in taxonomy.COMPATIBLE)}, {', '.join(f"('{a}', '{b}')" for a, b in taxonomy.ONE_WAY)}))
SELECT requirement_id, product_id, exact, CAST(shared AS INT) AS shared, row_number() OVER (PARTITION BY requirement_id ORDER BY exact DESC, shared DESC, product_id) AS rank_no FROM g QUALIFY row_number() OVER (PARTITION BY requirement_id ORDER BY exact DESC, shared DESC, product_id) <= 80""")
def gated_products(spark, d):
    """Every hundredth requirement against all products of its family and those that go with it, by an
    equi-join through the table of relations; the 80 with the most words in common."""
    asked = table(spark, d, "requirements").filter(F.regexp_extract("id", "[0-9]+", 0).try_cast("bigint") % 100 == 0)
    r = asked.select(F.col("id").alias("requirement_id"), F.col("taxonomy_family").alias("wanted"), text.tokens(F.concat_ws(" ", "fixture_type", "visual_description", "color")).alias("a"))
    p = table(spark, d, "catalog_products").select("product_id", F.col("product_family").alias("offered"), text.tokens(F.col("name")).alias("b"))
    near = r.join(taxonomy.relation_table(spark).filter("relation = 'compatible'"), "wanted").select("requirement_id", "a", "offered", F.lit(False).alias("exact"))
    same = r.filter("wanted <> 'unknown'").select("requirement_id", "a", F.col("wanted").alias("offered"), F.lit(True).alias("exact"))
    g = same.unionByName(near).join(p, "offered").select("requirement_id", "product_id", "exact", F.size(F.array_intersect("a", "b")).alias("shared"))
    return ranking.top_k(g, ["requirement_id"], [F.col("exact").desc(), F.col("shared").desc(), F.col("product_id")], 80)


_N = "CAST(regexp_extract(r.id, '[0-9]+') AS BIGINT)"


@query("j5_position", f"SELECT r.id AS requirement_id, s.product_id FROM requirements r LEFT JOIN scored_candidates s ON s.candidate_id = {_N}")
def by_position(spark, d):
    r = table(spark, d, "requirements").select(F.col("id").alias("requirement_id"), F.regexp_extract("id", "[0-9]+", 0).try_cast("bigint").alias("candidate_id"))
    return r.join(table(spark, d, "scored_candidates").select("candidate_id", "product_id"), "candidate_id", "left").select("requirement_id", "product_id")


@query("j13_both_scores", """SELECT s.requirement_id, c.canonical_url, max(CASE WHEN NOT isnan(s.visual_similarity) THEN s.visual_similarity END) AS image_score, max(CASE WHEN NOT isnan(s.overall_score) THEN s.overall_score END) AS final_score
FROM scored_candidates s JOIN catalog_products c USING (product_id) WHERE s.requirement_id IS NOT NULL GROUP BY 1, 2 HAVING image_score IS NOT NULL AND final_score IS NOT NULL""")
def both_scores(spark, d):
    """An address's best score by image and its best score in all, where it has both: one pass instead of a self-join."""
    number = lambda c: F.max(F.when(~F.isnan(c), F.col(c)))
    s = table(spark, d, "scored_candidates").filter("requirement_id is not null").select("requirement_id", "product_id", "visual_similarity", "overall_score")
    j = s.join(table(spark, d, "catalog_products").select("product_id", "canonical_url"), "product_id")
    return j.groupBy("requirement_id", "canonical_url").agg(number("visual_similarity").alias("image_score"), number("overall_score").alias("final_score")).filter("image_score is not null and final_score is not null")


# Functions -------------------------------------------------------------------------------------
@query("fn14_controlled_family", f"SELECT product_id, {taxonomy.sql_controlled('name', 'category', 'canonical_url')} AS family FROM catalog_products")
def controlled_family(spark, d):
    return table(spark, d, "catalog_products").select("product_id", taxonomy.controlled(F.col("name"), F.col("category"), F.col("canonical_url")).alias("family"))


@query("fn8_price_quantity", r"""SELECT supplier, canonical_url, product_url, title, TRY_CAST(replace(regexp_replace(regexp_extract(title, '[0-9][0-9 \t\n\r\f]*(?:[,.][0-9]{1,3})?'), '[ \t\n\r\f]+', '', 'g'), ',', '.') AS DOUBLE) AS price, TRY_CAST(regexp_extract(title, '[0-9]+') AS BIGINT) AS quantity FROM inventory_records""")
def price_quantity(spark, d):
    return table(spark, d, "inventory_records").select("supplier", "canonical_url", "product_url", "title", text.offer_price(F.col("title")).alias("price"), text.first_integer(F.col("title")).cast("bigint").alias("quantity"))


_BAD = " OR ".join(f"contains(lower(u), '{m}')" for m in pages.BAD_IMAGES)


@query("f8_image_filter", f"WITH u AS (SELECT product_id, unnest(list_concat(image_urls, ['https://x.example/logo.png', primary_image_url])) AS u FROM catalog_products) SELECT product_id, count(*) AS kept FROM u WHERE u IS NOT NULL AND NOT ({_BAD}) GROUP BY product_id")
def image_filter(spark, d):
    good = lambda u: u.isNotNull() & ~F.lower(u).rlike("|".join(pages.BAD_IMAGES))
    urls = F.concat(F.coalesce("image_urls", F.array().cast("array<string>")), F.array(F.lit("https://x.example/logo.png"), F.col("primary_image_url")))
    return table(spark, d, "catalog_products").select("product_id", F.size(F.filter(urls, good)).cast("long").alias("kept")).filter("kept > 0")


@query("f10_pool_families", "SELECT s.candidate_id FROM scored_candidates s JOIN requirements r ON r.id = s.requirement_id JOIN catalog_products c USING (product_id) WHERE c.product_family NOT IN ('unknown', 'accessory') AND c.product_family = r.taxonomy_family")
def pool_families(spark, d):
    """Candidates of the wanted family; accessories and unknown ones stay out of the pool."""
    r = table(spark, d, "requirements").select(F.col("id").alias("requirement_id"), F.col("taxonomy_family").alias("family"))
    c = table(spark, d, "catalog_products").filter("product_family not in ('unknown', 'accessory')").select("product_id", F.col("product_family").alias("family"))
    return table(spark, d, "scored_candidates").select("candidate_id", "requirement_id", "product_id").join(r, "requirement_id").join(c, ["product_id", "family"]).select("candidate_id")


_SELECTORS = [("lampovik.example", "^/[^/]+/[^/]+-[0-9a-z]+$"), ("fonarium.example", "^/(spot|floor-lamp)/"), ("example", "[0-9]$")]


@query("fn29_url_selectors", "WITH x AS (SELECT supplier, product_url, %s AS p FROM inventory_records) SELECT supplier, product_url, CASE WHEN supplier = 'lampovik.example' THEN regexp_matches(p, '%s') WHEN supplier = 'fonarium.example' THEN regexp_matches(p, '%s') ELSE regexp_matches(p, '%s') END AS selected FROM x" % (_PATH, *[p for _, p in _SELECTORS]))
def url_selectors(spark, d):
    """Which addresses are products' by the rule of their host, else of its nearest parent domain."""
    from shelfspark.functions import urls

    rules = spark.createDataFrame(_SELECTORS, "suffix string, pattern string")
    i = table(spark, d, "inventory_records").select("supplier", "product_url")
    return urls.selected(i, "product_url", rules).select("supplier", "product_url", "selected")


# Aggregates ------------------------------------------------------------------------------------
_COUNTERS = {
    "candidates": "true", "fits": "result_class = 'подходит'", "alike": "result_class = 'аналог'", "weak": "result_class = 'слабое сходство'", "primary_colour": "color_mode = 'primary'", "reviewed": "visual_review_status = 'проверено'",
    "rejected": "trim(coalesce(visual_reject_reason, '')) <> ''", "strong": "visual_fit = 'strong'", "verified": "technical_status = 'verified'", "available": "availability_status = 'in_stock'", "scored": "overall_score is not null and not isnan(overall_score)", "exact_family": "family_relation = 'exact'",
}


@query("a10_counters", f"SELECT r.id AS requirement_id, {', '.join(f'count_if(s.candidate_id IS NOT NULL AND {c}) AS {n}' for n, c in _COUNTERS.items())} FROM requirements r LEFT JOIN scored_candidates s ON s.requirement_id = r.id GROUP BY r.id")
def counters(spark, d):
    s = table(spark, d, "scored_candidates").filter("requirement_id is not null").groupBy("requirement_id").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _COUNTERS.items()])
    r = table(spark, d, "requirements").select(F.col("id").alias("requirement_id"))
    return r.join(s, "requirement_id", "left").select("requirement_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in _COUNTERS])


@query("a13_review_states", """SELECT requirement_id, count_if(visual_review_status = 'проверено' AND visual_reject_reason IS NULL) AS accepted, count_if(visual_review_status = 'проверено' AND trim(coalesce(visual_reject_reason, '')) <> '') AS rejected,
count_if(visual_review_status = 'проверено' AND coalesce(trim(visual_reject_reason) = '', false)) AS skipped, count_if(visual_review_status <> 'проверено') AS pending FROM scored_candidates GROUP BY requirement_id""")
def review_states(spark, d):
    seen, reason = F.col("visual_review_status") == "проверено", F.trim("visual_reject_reason")
    return table(spark, d, "scored_candidates").groupBy("requirement_id").agg(F.count_if(seen & reason.isNull()).alias("accepted"), F.count_if(seen & (reason != "")).alias("rejected"), F.count_if(seen & (reason == "")).alias("skipped"), F.count_if(~seen).alias("pending"))


@query("a18_performance", "SELECT event_type, count(*) AS runs, round(median(value), 6) AS median_value, round(avg(value), 6) AS mean_value, round(max(value), 6) AS slowest FROM events GROUP BY event_type")
def performance(spark, d):
    """Summaries of measured runs: median, mean and slowest."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.median("value"), 6).alias("median_value"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.max("value"), 6).alias("slowest"))


@query("a20_discovery_summary", "SELECT discovery_source, count(*) AS records, count_if(sku IS NOT NULL) AS with_sku, count_if(title IS NULL) AS untitled, count(DISTINCT supplier) AS suppliers FROM inventory_records GROUP BY GROUPING SETS ((discovery_source), ())")
def discovery_summary(spark, d):
    i = table(spark, d, "inventory_records")
    return i.rollup("discovery_source").agg(F.count("*").alias("records"), F.count_if(F.col("sku").isNotNull()).alias("with_sku"), F.count_if(F.col("title").isNull()).alias("untitled"), F.countDistinct("supplier").alias("suppliers"))


@query("a22_search_status", "SELECT coverage_status, taxonomy_family, count(*) AS requirements, count_if(n > 0) AS found, coalesce(sum(n), 0)::BIGINT AS candidates FROM requirements r LEFT JOIN (SELECT requirement_id, count(*) AS n FROM scored_candidates GROUP BY 1) s ON s.requirement_id = r.id GROUP BY 1, 2")
def search_status(spark, d):
    n = table(spark, d, "scored_candidates").groupBy(F.col("requirement_id").alias("id")).agg(F.count("*").alias("n"))
    r = table(spark, d, "requirements").select("id", "coverage_status", "taxonomy_family").join(n, "id", "left")
    return r.groupBy("coverage_status", "taxonomy_family").agg(F.count("*").alias("requirements"), F.count_if(F.col("n") > 0).alias("found"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))


# Review and benchmark --------------------------------------------------------------------------
_MID = "(SELECT CAST((epoch_us(min(scored_at)) + epoch_us(max(scored_at))) // 2 AS BIGINT) FROM scored_candidates)"
_PRINT = "SELECT requirement_id, sha256(string_agg(CAST(candidate_id AS VARCHAR), chr(10) ORDER BY CAST(candidate_id AS VARCHAR))) AS fp FROM (SELECT * FROM scored_candidates WHERE requirement_id IS NOT NULL AND NOT isnan(overall_score) AND overall_score IS NOT NULL {0} QUALIFY row_number() OVER (PARTITION BY requirement_id ORDER BY overall_score DESC, candidate_id) <= 20) GROUP BY 1"


def _print(scored):
    """Identity of each requirement's pool, its 20 best candidates."""
    pool = ranking.top_k(scored, ["requirement_id"], [F.col("overall_score").desc(), F.col("candidate_id")], 20)
    return pool.groupBy("requirement_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("candidate_id").cast("string"))), "\n"), 256).alias("fp"))


def _scored(spark, d):
    s = table(spark, d, "scored_candidates").filter("requirement_id is not null and overall_score is not null and not isnan(overall_score)")
    return s.select("requirement_id", "candidate_id", "overall_score", F.unix_micros(F.col("scored_at").cast("timestamp")).alias("at"))


@query("e8_staleness", f"WITH now AS ({_PRINT.format('')}), old AS ({_PRINT.format(f'AND epoch_us(scored_at) <= {_MID}')}) SELECT r.id AS requirement_id, CASE WHEN old.fp IS NULL THEN 'not_reviewed' WHEN old.fp = now.fp THEN 'current' ELSE 'stale' END AS state FROM requirements r LEFT JOIN old ON old.requirement_id = r.id LEFT JOIN now ON now.requirement_id = r.id")
def staleness(spark, d):
    """Reviews made half-way hold while the pool's fingerprint is still the one they were made for."""
    s = _scored(spark, d)
    ends = table(spark, d, "scored_candidates").agg(F.min("scored_at").alias("a"), F.max("scored_at").alias("b")).first()  # one row
    micros = lambda t: spark.range(1).select(F.unix_micros(F.lit(t).cast("timestamp"))).first()[0]
    mid = (micros(ends.a) + micros(ends.b)) // 2 if ends.a is not None else 0
    old, now = _print(s.filter(F.col("at") <= mid)).withColumnRenamed("fp", "old"), _print(s)
    state = F.when(F.col("old").isNull(), "not_reviewed").when(F.col("old") == F.col("fp"), "current").otherwise("stale")
    r = table(spark, d, "requirements").select(F.col("id").alias("requirement_id"))
    return r.join(old, "requirement_id", "left").join(now, "requirement_id", "left").select("requirement_id", state.alias("state"))


@query("e5_manifest", """WITH p AS (SELECT * FROM scored_candidates WHERE requirement_id IS NOT NULL AND visual_review_status = 'не проверено' QUALIFY row_number() OVER (PARTITION BY requirement_id ORDER BY overall_score DESC NULLS LAST, candidate_id) <= 10)
SELECT requirement_id, count(*) AS pending, string_agg(CAST(candidate_id AS VARCHAR), ' ' ORDER BY candidate_id) AS manifest FROM p GROUP BY requirement_id""")
def manifest(spark, d):
    """What is left to review of a requirement, its ten best candidates at a time."""
    s = table(spark, d, "scored_candidates").filter("requirement_id is not null and visual_review_status = 'не проверено'").select("requirement_id", "candidate_id", "overall_score")
    best = ranking.top_k(s, ["requirement_id"], [F.col("overall_score").desc_nulls_last(), F.col("candidate_id")], 10)
    return best.groupBy("requirement_id").agg(F.count("*").alias("pending"), F.array_join(F.transform(F.array_sort(F.collect_list("candidate_id")), lambda x: x.cast("string")), " ").alias("manifest"))


@query("e6_benchmark", """WITH s AS (SELECT requirement_id, candidate_id, family_relation, visual_review_status, row_number() OVER (PARTITION BY requirement_id ORDER BY overall_score DESC, candidate_id) AS n FROM scored_candidates WHERE requirement_id IS NOT NULL AND overall_score IS NOT NULL AND NOT isnan(overall_score)),
t AS (SELECT requirement_id, count(*) AS pool, min(CASE WHEN family_relation = 'exact' THEN n END) AS place, count_if(visual_review_status <> 'проверено' AND n <= 10) = 0 AS reviewed FROM s GROUP BY 1),
q AS (SELECT coalesce(r.taxonomy_family, 'unknown') AS family, coalesce(pool, 0) AS pool, place, coalesce(reviewed, false) AS reviewed FROM requirements r LEFT JOIN t ON t.requirement_id = r.id)
SELECT family, count(*) AS targets, count_if(pool > 0) AS with_pool, count_if(reviewed) AS reviewed, round(count_if(place <= 1) / count(*), 4) AS recall_1, round(count_if(place <= 5) / count(*), 4) AS recall_5, round(count_if(place <= 20) / count(*), 4) AS recall_20,
round(sum(coalesce(1.0 / place, 0)) / count(*), 4) AS mrr, count_if(pool = 0) AS inventory_miss, count_if(pool > 0 AND place IS NULL) AS family_miss FROM q GROUP BY GROUPING SETS ((family), ())""")
def benchmark(spark, d):
    """The benchmark as a whole: pools, review, recall and what went wrong, by family and in all."""
    s = table(spark, d, "scored_candidates").filter("requirement_id is not null and overall_score is not null and not isnan(overall_score)").select("requirement_id", "candidate_id", "family_relation", "visual_review_status", "overall_score")
    ranked = ranking.top_k(s, ["requirement_id"], [F.col("overall_score").desc(), F.col("candidate_id")], 2**31 - 1, "n")
    t = ranked.groupBy(F.col("requirement_id").alias("id")).agg(F.count("*").alias("pool"), F.min(F.when(F.col("family_relation") == "exact", F.col("n"))).alias("place"), (F.count_if((F.col("visual_review_status") != "проверено") & (F.col("n") <= 10)) == 0).alias("reviewed"))
    q = table(spark, d, "requirements").select("id", F.coalesce("taxonomy_family", F.lit("unknown")).alias("family")).join(t, "id", "left").withColumn("pool", F.coalesce("pool", F.lit(0)))
    share = lambda k: F.round(F.count_if(F.col("place") <= k) / F.count("*"), 4).alias(f"recall_{k}")
    return q.rollup("family").agg(
        F.count("*").alias("targets"), F.count_if(F.col("pool") > 0).alias("with_pool"), F.count_if("reviewed").alias("reviewed"), share(1), share(5), share(20),
        F.round(F.sum(F.coalesce(F.lit(1.0) / F.col("place"), F.lit(0.0))) / F.count("*"), 4).alias("mrr"), F.count_if(F.col("pool") == 0).alias("inventory_miss"), F.count_if((F.col("pool") > 0) & F.col("place").isNull()).alias("family_miss"),
    )


QUERIES, ORACLE = query.queries, query.oracle
