"""Queries of joins, aggregations, upserts, windows and set operations over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.times import instant_micros
from shelfspark.operators import ranking, relevance, upsert
from shelfspark.plans.base import Registry
from shelfspark.plans.functions import _P, TOKENS
from shelfspark.session import table

query = Registry()
def _best():
    return [F.col("overall_score").desc_nulls_last(), F.col("candidate_id").asc()]


# Upserts ---------------------------------------------------------------------------------------
_INV_KEEP = ["category", "category_url", "title", "sku", "brand", "image_url"]


def _inventory_log(spark, d):
    """Discoveries in order of time; rows found at the same instant in order of their address."""
    return table(spark, d, "inventory_records").select("*", F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ["product_url", *_INV_KEEP]]).alias("_tie"))


_TIE = "concat_ws('|', " + ", ".join(f"coalesce({c}, '')" for c in ["product_url", *_INV_KEEP]) + ")"


_UPSERT = f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY supplier, canonical_url ORDER BY discovered_at, {_TIE}) AS n FROM inventory_records)
SELECT supplier, canonical_url, arg_max(product_url, n) AS product_url, arg_max(discovery_source, n) AS discovery_source, max(discovered_at) AS discovered_at,
 {', '.join(f'arg_max({c}, n) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in _INV_KEEP)} FROM o GROUP BY supplier, canonical_url"""


@query("k2_inventory_upsert", _UPSERT)
def inventory_upsert(spark, d):
    return upsert.upsert(_inventory_log(spark, d), ["supplier", "canonical_url"], ["discovered_at", "_tie"], ["product_url", "discovery_source", "discovered_at"], _INV_KEEP)


_CAT_KEEP = ["sku", "brand", "primary_image_url", "local_image_path"]
_CAT_OVER = ["supplier", "name", "category", "price", "currency", "availability_status", "width_mm", "height_mm", "diameter_mm", "color", "updated_at"]


@query("k1_catalog_upsert", f"""SELECT canonical_url, {', '.join(f'arg_max_null({c}, product_id) AS {c}' for c in _CAT_OVER)}, {', '.join(f"arg_max({c}, product_id) FILTER (WHERE {c} <> '') AS {c}" for c in _CAT_KEEP)} FROM catalog_products GROUP BY canonical_url""")
def catalog_upsert(spark, d):
    return upsert.upsert(table(spark, d, "catalog_products"), ["canonical_url"], ["product_id"], _CAT_OVER, _CAT_KEEP, empty_counts=False)


@query("k3_corpus_upsert", f"""WITH r AS (SELECT 'natural' AS scope, canonical_url, product_id AS seq, supplier, source_url AS product_url, sku, name AS title, brand, category, primary_image_url FROM catalog_products
 UNION ALL SELECT 'natural', canonical_url, -1, supplier, product_url, max(sku), max(title), max(brand), max(category), max(image_url) FROM inventory_records GROUP BY canonical_url, supplier, product_url)
SELECT scope, canonical_url, arg_max(supplier, struct_pack(a := seq, b := product_url)) AS supplier, arg_max(product_url, struct_pack(a := seq, b := product_url)) AS product_url, {', '.join(f'arg_max({c}, struct_pack(a := seq, b := product_url)) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in ('sku', 'title', 'brand', 'category', 'primary_image_url'))} FROM r GROUP BY scope, canonical_url""")
def corpus_upsert(spark, d):
    keep = ["sku", "title", "brand", "category", "primary_image_url"]
    new = table(spark, d, "catalog_products").select("canonical_url", F.col("product_id").alias("seq"), "supplier", F.col("source_url").alias("product_url"), "sku", F.col("name").alias("title"), "brand", "category", "primary_image_url")
    old = table(spark, d, "inventory_records").groupBy("canonical_url", "supplier", "product_url").agg(*[F.max(a).alias(b) for a, b in (("sku", "sku"), ("title", "title"), ("brand", "brand"), ("category", "category"), ("image_url", "primary_image_url"))])
    rows = new.unionByName(old.withColumn("seq", F.lit(-1).cast("long"))).withColumn("scope", F.lit("natural"))
    return upsert.upsert(rows, ["scope", "canonical_url"], ["seq", "product_url"], ["supplier", "product_url"], keep)


@query("k4_latest", "SELECT product_id, load_seq, availability_status, price FROM product_updates QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY load_seq DESC) = 1")
def latest(spark, d):
    return upsert.latest(table(spark, d, "product_updates").select("product_id", "load_seq", "availability_status", "price"), ["product_id"], ["load_seq"])


@query("k5_refresh_delete", """SELECT supplier, product_url, canonical_url FROM inventory_records i WHERE NOT EXISTS (SELECT 1 FROM catalog_products c WHERE c.canonical_url = i.canonical_url AND c.category IS NULL)""")
def refresh(spark, d):
    """Stored addresses whose page, by the last crawl, is no categorised product's are deleted."""
    pages = table(spark, d, "catalog_products").select("canonical_url", F.col("category").isNotNull().alias("is_product"))
    keep, _ = upsert.refresh(table(spark, d, "inventory_records").select("supplier", "product_url", "canonical_url"), pages, "canonical_url")
    return keep.select("supplier", "product_url", "canonical_url")


# Aggregations ----------------------------------------------------------------------------------
@query("a1_totals", "SELECT count(*) AS products, count(DISTINCT canonical_url) AS addresses FROM catalog_products")
def totals(spark, d):
    return table(spark, d, "catalog_products").agg(F.count("*").alias("products"), F.countDistinct("canonical_url").alias("addresses"))


@query("a2_supplier_counts", "SELECT supplier, count(*) AS n FROM inventory_records GROUP BY supplier")
def supplier_counts(spark, d):
    return table(spark, d, "inventory_records").groupBy("supplier").agg(F.count("*").alias("n"))


@query("a3_status_counts", "SELECT availability_status, count(*) AS n FROM catalog_products WHERE image_source IS NOT NULL GROUP BY availability_status")
def status_counts(spark, d):
    return table(spark, d, "catalog_products").filter("image_source is not null").groupBy("availability_status").agg(F.count("*").alias("n"))


@query("a4_pool_diagnostics", """SELECT requirement_id, count(*) AS total, count_if(family_relation = 'incompatible') AS other_family, count_if(dimension_match = 0) AS other_dimensions, count_if(color_mode = 'primary') AS primary_color,
 least(count_if(overall_score >= 0.55), 80) AS pool FROM scored_candidates WHERE requirement_id IS NOT NULL GROUP BY requirement_id""")
def pool_diagnostics(spark, d):
    s = table(spark, d, "scored_candidates").filter("requirement_id is not null")
    return s.groupBy("requirement_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("family_relation") == "incompatible").alias("other_family"), F.count_if(F.col("dimension_match") == 0).alias("other_dimensions"),
        F.count_if(F.col("color_mode") == "primary").alias("primary_color"), F.least(F.count_if(F.col("overall_score") >= 0.55), F.lit(80).cast("long")).alias("pool"),
    )


_FIELDS = ["sku", "price", "width_mm", "primary_image_url", "brand"]


@query("a5_collection_stats", f"""SELECT supplier, count(*) AS products, {', '.join(f'count({c}) AS with_{c}' for c in _FIELDS)}, round(count(sku) / count(*), 6) AS sku_rate,
 CASE WHEN count(sku) / count(*) >= 0.5 THEN 'healthy' WHEN count(sku) > 0 THEN 'partial' ELSE 'broken' END AS quality FROM catalog_products GROUP BY supplier""")
def collection_stats(spark, d):
    rate = F.count("sku") / F.count("*")
    return table(spark, d, "catalog_products").groupBy("supplier").agg(
        F.count("*").alias("products"), *[F.count(c).alias(f"with_{c}") for c in _FIELDS], F.round(rate, 6).alias("sku_rate"),
        F.when(rate >= 0.5, "healthy").when(F.count("sku") > 0, "partial").otherwise("broken").alias("quality"),
    )


@query("a5_status_pivot", """SELECT supplier, count_if(availability_status = 'in_stock') AS in_stock, count_if(availability_status = 'out_of_stock') AS out_of_stock, count_if(availability_status = 'preorder') AS preorder FROM catalog_products GROUP BY supplier""")
def status_pivot(spark, d):
    wanted = ["in_stock", "out_of_stock", "preorder"]
    pivoted = table(spark, d, "catalog_products").groupBy("supplier").pivot("availability_status", wanted).agg(F.count(F.lit(1)))
    return pivoted.select("supplier", *[F.coalesce(c, F.lit(0)).alias(c) for c in wanted])


@query("a6_coverage", """WITH i AS (SELECT supplier, count(DISTINCT canonical_url) AS found FROM inventory_records GROUP BY supplier), c AS (SELECT supplier, count(DISTINCT canonical_url) AS fetched FROM catalog_products GROUP BY supplier)
SELECT i.supplier, found, coalesce(fetched, 0) AS fetched, round(least(coalesce(fetched, 0) / found, 1.0), 6) AS coverage FROM i LEFT JOIN c USING (supplier)""")
def coverage(spark, d):
    found = table(spark, d, "inventory_records").groupBy("supplier").agg(F.countDistinct("canonical_url").alias("found"))
    fetched = table(spark, d, "catalog_products").groupBy("supplier").agg(F.countDistinct("canonical_url").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return found.join(fetched, "supplier", "left").select("supplier", "found", n.alias("fetched"), F.round(F.least(F.try_divide(n, F.col("found")), F.lit(1.0)), 6).alias("coverage"))


@query("a24_fingerprint", """SELECT s.requirement_id, count(*) AS candidates, sha256(string_agg(c.supplier || '|' || coalesce(c.sku, '') || '|' || c.canonical_url, chr(10) ORDER BY c.supplier || '|' || coalesce(c.sku, '') || '|' || c.canonical_url)) AS fingerprint
FROM (SELECT * FROM scored_candidates WHERE requirement_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY requirement_id ORDER BY overall_score DESC NULLS LAST, candidate_id) <= 100) s JOIN catalog_products c USING (product_id) GROUP BY s.requirement_id""")
def fingerprint(spark, d):
    """Identity of a requirement's pool (its 100 best candidates), whatever their order."""
    pool = ranking.top_k(table(spark, d, "scored_candidates").filter("requirement_id is not null").select("requirement_id", "product_id", "overall_score", "candidate_id"), ["requirement_id"], _best(), 100)
    key = F.concat_ws("|", "supplier", F.coalesce("sku", F.lit("")), "canonical_url")
    products = table(spark, d, "catalog_products").select("product_id", key.alias("key"))
    return pool.join(products, "product_id").groupBy("requirement_id").agg(F.count("*").alias("candidates"), F.sha2(F.array_join(F.array_sort(F.collect_list("key")), "\n"), 256).alias("fingerprint"))


@query("a7_rollup", "SELECT requirement_id, supplier, count(*) AS n FROM scored_candidates GROUP BY ROLLUP (requirement_id, supplier)")
def rollup(spark, d):
    return table(spark, d, "scored_candidates").rollup("requirement_id", "supplier").agg(F.count("*").alias("n"))


@query("a10_by_requirement", """SELECT r.id AS requirement_id, count(s.candidate_id) AS candidates, count(DISTINCT s.product_id) AS products, count(*) FILTER (WHERE s.visual_review_status = 'accepted') AS accepted, round(sum(CASE WHEN NOT isnan(s.overall_score) THEN s.overall_score END), 6) AS total_score,
 max(CASE WHEN NOT isnan(s.overall_score) THEN s.overall_score END) AS best_score FROM requirements r LEFT JOIN scored_candidates s ON r.id = s.requirement_id GROUP BY r.id""")
def by_requirement(spark, d):
    r = table(spark, d, "requirements").select(F.col("id").alias("requirement_id"))
    score = F.when(~F.isnan("overall_score"), F.col("overall_score"))
    s = table(spark, d, "scored_candidates").filter("requirement_id is not null").groupBy("requirement_id").agg(
        F.count("candidate_id").alias("candidates"), F.countDistinct("product_id").alias("products"), F.count_if(F.col("visual_review_status") == "accepted").alias("accepted"), F.round(F.sum(score), 6).alias("total_score"), F.max(score).alias("best_score"),
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("candidates", "products", "accepted")]
    return r.join(s, "requirement_id", "left").select("requirement_id", *zero, "total_score", "best_score")


@query("a13_review_completeness", """SELECT requirement_id, count_if(visual_review_status = 'accepted') AS accepted, count_if(visual_review_status = 'rejected' AND trim(coalesce(visual_reject_reason, '')) <> '') AS rejected,
 count(*) - count_if(visual_review_status = 'accepted') - count_if(visual_review_status = 'rejected' AND trim(coalesce(visual_reject_reason, '')) <> '') AS pending FROM scored_candidates GROUP BY requirement_id""")
def review_completeness(spark, d):
    yes = F.count_if(F.col("visual_review_status") == "accepted")
    no = F.count_if((F.col("visual_review_status") == "rejected") & (F.trim(F.coalesce("visual_reject_reason", F.lit(""))) != ""))
    return table(spark, d, "scored_candidates").groupBy("requirement_id").agg(yes.alias("accepted"), no.alias("rejected"), (F.count("*") - yes - no).alias("pending"))


# Joins -----------------------------------------------------------------------------------------
@query("j1_equi", "SELECT s.candidate_id, c.canonical_url, c.name FROM scored_candidates s JOIN catalog_products c USING (product_id)")
def equi(spark, d):
    return table(spark, d, "scored_candidates").select("candidate_id", "product_id").join(table(spark, d, "catalog_products").select("product_id", "canonical_url", "name"), "product_id").drop("product_id")


@query("j4_left_or", """SELECT i.supplier, i.product_url, i.discovered_at, min(c.product_id) AS product_id FROM inventory_records i LEFT JOIN catalog_products c ON i.supplier = c.supplier AND (i.canonical_url = c.canonical_url OR i.sku = c.sku) GROUP BY ALL""")
def left_or(spark, d):
    """A left join on one of two keys: two equi-joins, united, instead of a nested loop."""
    i = table(spark, d, "inventory_records").select("supplier", "product_url", "discovered_at", "canonical_url", "sku").distinct()
    c = table(spark, d, "catalog_products").select("supplier", "canonical_url", "sku", "product_id")
    by_url = c.groupBy("supplier", "canonical_url").agg(F.min("product_id").alias("a"))
    by_sku = c.filter("sku is not null").groupBy("supplier", "sku").agg(F.min("product_id").alias("b"))
    both = i.join(by_url, ["supplier", "canonical_url"], "left").join(by_sku, ["supplier", "sku"], "left")
    return both.groupBy("supplier", "product_url", "discovered_at").agg(F.min(F.least("a", "b")).alias("product_id"))


@query("j6_left_unmatched", """SELECT s.candidate_id, coalesce(r.taxonomy_family, CASE WHEN r.id IS NULL THEN 'no_requirement_mapping' ELSE 'unknown' END) AS family FROM scored_candidates s LEFT JOIN requirements r ON s.requirement_id = r.id""")
def left_unmatched(spark, d):
    r = table(spark, d, "requirements").select(F.col("id").alias("requirement_id"), "taxonomy_family", F.lit(True).alias("hit"))
    return table(spark, d, "scored_candidates").select("candidate_id", "requirement_id").join(r, "requirement_id", "left").select("candidate_id", F.coalesce("taxonomy_family", F.when(F.col("hit").isNull(), "no_requirement_mapping").otherwise("unknown")).alias("family"))


_SKU = "regexp_replace(lower({0}), '[^0-9a-zа-яё]+', '', 'g')"


@query("j7_first_match", f"""WITH c AS (SELECT {_SKU.format('sku')} AS k, min(canonical_url) AS first_url FROM catalog_products WHERE {_SKU.format('sku')} <> '' GROUP BY 1)
SELECT i.supplier, i.product_url, i.discovered_at, c.first_url FROM inventory_records i LEFT JOIN c ON {_SKU.format('i.sku')} = c.k""")
def first_match(spark, d):
    key = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-zа-яё]+", "")
    c = table(spark, d, "catalog_products").select(key("sku").alias("k"), "canonical_url").filter("k <> ''").groupBy("k").agg(F.min("canonical_url").alias("first_url"))
    return table(spark, d, "inventory_records").select("supplier", "product_url", "discovered_at", key("sku").alias("k")).join(c, "k", "left").drop("k")


@query("j10_full_outer", """WITH a AS (SELECT supplier, count(*) AS found FROM inventory_records GROUP BY 1), b AS (SELECT supplier, count(*) AS fetched FROM catalog_products GROUP BY 1), c AS (SELECT supplier, count(*) AS scored FROM scored_candidates GROUP BY 1)
SELECT supplier, coalesce(found, 0) AS found, coalesce(fetched, 0) AS fetched, coalesce(scored, 0) AS scored FROM a FULL JOIN b USING (supplier) FULL JOIN c USING (supplier)""")
def full_outer(spark, d):
    """Three counts side by side: one union and one aggregation instead of two outer joins."""
    parts = [table(spark, d, t).groupBy("supplier").agg(F.count("*").alias("n")).withColumn("what", F.lit(w)) for t, w in (("inventory_records", "found"), ("catalog_products", "fetched"), ("scored_candidates", "scored"))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("supplier").agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in ("found", "fetched", "scored")])


@query("j16_semi", "SELECT product_id, canonical_url FROM catalog_products c WHERE EXISTS (SELECT 1 FROM scored_candidates s WHERE s.product_id = c.product_id)")
def semi(spark, d):
    return table(spark, d, "catalog_products").select("product_id", "canonical_url").join(table(spark, d, "scored_candidates").select("product_id"), "product_id", "left_semi")


@query("j17_anti", "SELECT supplier, product_url, canonical_url FROM inventory_records i WHERE NOT EXISTS (SELECT 1 FROM catalog_products c WHERE c.canonical_url = i.canonical_url)")
def anti(spark, d):
    return table(spark, d, "inventory_records").select("supplier", "product_url", "canonical_url").join(table(spark, d, "catalog_products").select("canonical_url"), "canonical_url", "left_anti").select("supplier", "product_url", "canonical_url")


@query("j15_guarded", """WITH f AS (SELECT requirement_id, max(candidate_id) AS newest, max(scored_at) AS scored FROM scored_candidates GROUP BY 1)
SELECT s.candidate_id, CASE WHEN s.visual_review_status = 'unreviewed' THEN 'not_reviewed' WHEN s.scored_at < f.scored - INTERVAL 7 DAY THEN 'stale' ELSE 'current' END AS review_state FROM scored_candidates s JOIN f USING (requirement_id)""")
def guarded(spark, d):
    s = table(spark, d, "scored_candidates").select("candidate_id", "requirement_id", "visual_review_status", "scored_at").filter("requirement_id is not null")
    f = s.groupBy("requirement_id").agg(F.max("scored_at").alias("scored"))
    state = F.when(F.col("visual_review_status") == "unreviewed", "not_reviewed").when(F.col("scored_at") < F.col("scored") - F.expr("interval 7 days"), "stale").otherwise("current")
    return s.join(f, "requirement_id").select("candidate_id", state.alias("review_state"))


# Windows, samples, sets ------------------------------------------------------------------------
_REQ = "CAST(regexp_extract(id, '[0-9]+') AS BIGINT) % 100 = 0"
_KW = " ".join("WHEN '{}' THEN [{}]".format(k, ", ".join(f"'{w}'" for w in v)) for k, v in relevance.FAMILY_KEYWORDS.items())
_LONG = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 4)"
_PLAN = f"""WITH q AS (SELECT id AS requirement_id, coalesce(CASE taxonomy_family {_KW} END, CAST([] AS VARCHAR[])) AS keywords, {_LONG.format("concat_ws(' ', fixture_type, visual_description, shape, mounting, color, array_to_string(technical_constraints, ' '))")} AS words,
 {_LONG.format('mounting')} AS mounts, {_LONG.format('color')} AS colours FROM requirements WHERE {_REQ}),
i AS (SELECT supplier, canonical_url, lower(concat_ws(' ', {', '.join(f"coalesce({c}, '')" for c in relevance.RECORD_FIELDS)})) AS txt FROM ({_UPSERT})),
s AS (SELECT requirement_id, supplier, canonical_url, greatest(10 * len(list_filter(keywords, lambda t: contains(txt, t))) + 2 * len(list_filter(words, lambda t: contains(txt, t))) + CASE WHEN len(list_filter(mounts, lambda t: contains(txt, t))) > 0 THEN 3 ELSE 0 END + CASE WHEN len(list_filter(colours, lambda t: contains(txt, t))) > 0 THEN 2 ELSE 0 END, 1) AS score FROM q, i),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY requirement_id, supplier ORDER BY score DESC, canonical_url) <= 30),
p AS (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY score DESC, supplier, canonical_url) AS rank_no FROM k)
SELECT requirement_id, rank_no, supplier, canonical_url, CAST(score AS BIGINT) AS score FROM p WHERE rank_no <= 180"""


@query("w1_hydration_plan", _PLAN)
def hydration_plan(spark, d):
    """Every requirement whose number is divisible by 100 against all inventory records."""
    asked = table(spark, d, "requirements").filter(F.regexp_extract("id", "[0-9]+", 0).try_cast("bigint") % 100 == 0)
    return relevance.hydration_plan(asked, inventory_upsert(spark, d))


_WHOLE_PLAN = _PLAN.replace(f" WHERE {_REQ}", "")


@query("w2_plan_unique", f"SELECT canonical_url, max(requirement_id) AS requirement_id FROM ({_WHOLE_PLAN}) GROUP BY canonical_url")
def plan_unique(spark, d):
    """The addresses of the whole plan, each once; the last requirement that chose it holds."""
    return relevance.plan_addresses(table(spark, d, "requirements"), inventory_upsert(spark, d))


@query("a7_hydration_counts", f"SELECT requirement_id, supplier, count(*) AS selected FROM ({_WHOLE_PLAN}) GROUP BY ROLLUP (requirement_id, supplier)")
def hydration_counts(spark, d):
    """Of the whole plan."""
    counts = relevance.hydration_counts(table(spark, d, "requirements"), inventory_upsert(spark, d))
    return counts.rollup("requirement_id", "supplier").agg(F.sum("selected").alias("selected"))


@query("w3_wide_pool", """SELECT requirement_id, candidate_id, row_number() OVER w AS rank_no FROM scored_candidates WHERE requirement_id IS NOT NULL AND overall_score IS NOT NULL AND NOT isnan(overall_score)
WINDOW w AS (PARTITION BY requirement_id ORDER BY CASE WHEN color_mode = 'primary' THEN 0 ELSE 1 END, overall_score DESC, supplier, candidate_id) QUALIFY row_number() OVER w <= 80""")
def wide_pool(spark, d):
    s = table(spark, d, "scored_candidates").filter("requirement_id is not null and overall_score is not null and not isnan(overall_score)").select("requirement_id", "candidate_id", "color_mode", "overall_score", "supplier")
    order = [F.when(F.col("color_mode") == "primary", 0).otherwise(1), F.col("overall_score").desc(), F.col("supplier"), F.col("candidate_id")]
    return ranking.top_k(s, ["requirement_id"], order, 80).select("requirement_id", "candidate_id", "rank_no")


@query("w8_stored_images", """SELECT product_id, position, image_url FROM (SELECT product_id, unnest(range(len(image_urls))) AS position, unnest(image_urls) AS image_url FROM catalog_products) WHERE position < 3""")
def stored_images(spark, d):
    """A product's first three images in order, without a window."""
    return table(spark, d, "catalog_products").select("product_id", F.posexplode(F.slice("image_urls", 1, 3)).alias("position", "image_url")).withColumn("position", F.col("position").cast("long"))


@query("w10_hash_sample", """SELECT supplier, product_id FROM catalog_products QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY sha256(concat_ws('|', 'controlled-v1', supplier, canonical_url)), canonical_url, product_id) <= 20""")
def hash_sample(spark, d):
    p = table(spark, d, "catalog_products").select("supplier", "product_id", "canonical_url")
    h = F.sha2(F.concat_ws("|", F.lit("controlled-v1"), "supplier", "canonical_url"), 256)
    return ranking.top_k(p.withColumn("h", h), ["supplier"], [F.col("h"), F.col("canonical_url"), F.col("product_id")], 20).select("supplier", "product_id")


@query("w11_even_sample", """WITH r AS (SELECT supplier, product_id, row_number() OVER (PARTITION BY supplier ORDER BY product_id) - 1 AS i, count(*) OVER (PARTITION BY supplier) AS n FROM catalog_products)
SELECT supplier, product_id FROM r WHERE n <= 7 OR list_contains(list_transform(range(7), lambda j: CAST(round_even(j * (n - 1) / 6, 0) AS BIGINT)), i)""")
def even_sample(spark, d):
    return ranking.even_sample(table(spark, d, "catalog_products").select("supplier", "product_id"), ["supplier"], [F.col("product_id")], 7)


@query("w13_first_success", """SELECT supplier, arg_min(canonical_url, struct_pack(a := -length(canonical_url), b := canonical_url)) AS canonical_url FROM catalog_products WHERE sku IS NOT NULL GROUP BY supplier""")
def first_success(spark, d):
    p = table(spark, d, "catalog_products").filter("sku is not null")
    return p.groupBy("supplier").agg(F.min_by("canonical_url", F.struct(-F.length("canonical_url"), "canonical_url")).alias("canonical_url"))


@query("w14_unique_limited", """SELECT supplier, canonical_url FROM (SELECT supplier, canonical_url, min(product_id) AS p FROM catalog_products GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY p) <= 25""")
def unique_limited(spark, d):
    firsts = table(spark, d, "catalog_products").groupBy("supplier", "canonical_url").agg(F.min("product_id").alias("p"))
    return ranking.top_k(firsts, ["supplier"], [F.col("p")], 25).select("supplier", "canonical_url")


@query("k8_contact_sheets", """SELECT requirement_id, candidate_id, rank_no, (rank_no - 1) // 20 + 1 AS sheet FROM (SELECT requirement_id, candidate_id, row_number() OVER (PARTITION BY requirement_id ORDER BY overall_score DESC NULLS LAST, candidate_id) AS rank_no FROM scored_candidates WHERE requirement_id IS NOT NULL) WHERE rank_no <= 100""")
def contact_sheets(spark, d):
    s = table(spark, d, "scored_candidates").filter("requirement_id is not null").select("requirement_id", "candidate_id", "overall_score")
    return ranking.top_k(s, ["requirement_id"], _best(), 100).select("requirement_id", "candidate_id", "rank_no", (F.floor((F.col("rank_no") - 1) / 20) + 1).cast("long").alias("sheet"))


@query("u1_union_distinct", "SELECT canonical_url FROM catalog_products UNION SELECT canonical_url FROM inventory_records")
def union_distinct(spark, d):
    return table(spark, d, "catalog_products").select("canonical_url").unionByName(table(spark, d, "inventory_records").select("canonical_url")).distinct()


@query("u2_union_tagged", "SELECT 'natural' AS scope, canonical_url FROM catalog_products UNION ALL SELECT 'oracle', canonical_url FROM inventory_records WHERE sku IS NOT NULL")
def union_tagged(spark, d):
    a = table(spark, d, "catalog_products").select(F.lit("natural").alias("scope"), "canonical_url")
    return a.unionByName(table(spark, d, "inventory_records").filter("sku is not null").select(F.lit("oracle").alias("scope"), "canonical_url"))


@query("u4_first_wins", "SELECT product_family, primary_image_url, min(product_id) AS product_id FROM catalog_products WHERE primary_image_url IS NOT NULL GROUP BY 1, 2")
def first_wins(spark, d):
    p = table(spark, d, "catalog_products").filter("primary_image_url is not null").select("product_family", "primary_image_url", "product_id")
    return ranking.first_wins(p, ["product_family", "primary_image_url"], ["product_id"])


@query("u5_positive_overrides", """SELECT regexp_replace(lower(canonical_url), '/+$', '') AS url_key, arg_min(product_id, struct_pack(a := CASE WHEN sku IS NULL THEN 1 ELSE 0 END, b := product_id)) AS product_id FROM catalog_products GROUP BY 1""")
def positive_overrides(spark, d):
    p = table(spark, d, "catalog_products").select(F.regexp_replace(F.lower("canonical_url"), "/+$", "").alias("url_key"), F.col("sku").isNull().cast("int").alias("rank"), "product_id")
    return p.groupBy("url_key").agg(F.min_by("product_id", F.struct("rank", "product_id")).alias("product_id"))


@query("u6_ordered_distinct", "SELECT candidate_id, list_filter(differences, lambda x, i: list_position(differences, x) = i) AS differences FROM scored_candidates")
def ordered_distinct(spark, d):
    return table(spark, d, "scored_candidates").select("candidate_id", F.array_distinct("differences").alias("differences"))


@query("u7_token_overlap", f"""WITH t AS (SELECT candidate_id, {TOKENS.format('r.visual_description')} AS a, {TOKENS.format('c.name')} AS b FROM scored_candidates s JOIN requirements r ON s.requirement_id = r.id JOIN catalog_products c ON s.product_id = c.product_id)
SELECT candidate_id, CAST(len(list_intersect(a, b)) AS INT) AS shared, len(list_intersect(a, b)) > 0 AS overlaps FROM t""")
def token_overlap(spark, d):
    from shelfspark.functions.text import tokens

    r = table(spark, d, "requirements").select(F.col("id").alias("requirement_id"), tokens(F.col("visual_description")).alias("a"))
    c = table(spark, d, "catalog_products").select("product_id", tokens(F.col("name")).alias("b"))
    s = table(spark, d, "scored_candidates").select("candidate_id", "requirement_id", "product_id").join(r, "requirement_id").join(c, "product_id")
    return s.select("candidate_id", F.size(F.array_intersect("a", "b")).alias("shared"), F.arrays_overlap("a", "b").alias("overlaps"))


@query("u9_except", "SELECT supplier, canonical_url FROM inventory_records EXCEPT SELECT supplier, canonical_url FROM catalog_products")
def except_(spark, d):
    """The addresses that were discovered and never fetched."""
    return table(spark, d, "inventory_records").select("supplier", "canonical_url").subtract(table(spark, d, "catalog_products").select("supplier", "canonical_url"))


# Scans -----------------------------------------------------------------------------------------
@query("s4_supplier_scan", "SELECT product_id, supplier, name FROM catalog_products WHERE supplier IN ('lampovik.example', 'fonarium.example')")
def supplier_scan(spark, d):
    return table(spark, d, "catalog_products").filter(F.col("supplier").isin("lampovik.example", "fonarium.example")).select("product_id", "supplier", "name")


@query("s7_scope_scan", "SELECT product_id, canonical_url FROM catalog_products WHERE image_source = 'page' AND primary_image_url IS NOT NULL")
def scope_scan(spark, d):
    return table(spark, d, "catalog_products").filter("image_source = 'page' and primary_image_url is not null").select("product_id", "canonical_url")


@query("s9_point_lookup", f"""WITH w AS (SELECT DISTINCT canonical_url FROM inventory_records WHERE discovery_source = 'sitemap' AND regexp_extract(product_url, {_P}, 5) <> '') SELECT c.product_id, c.canonical_url FROM catalog_products c JOIN w USING (canonical_url)""")
def point_lookup(spark, d):
    """Many lookups by key are one equi-join, never one request each."""
    wanted = table(spark, d, "inventory_records").filter("discovery_source = 'sitemap' and product_url like '%#_%'").select("canonical_url").distinct()
    return table(spark, d, "catalog_products").select("product_id", "canonical_url").join(wanted, "canonical_url")


@query("t1_instants", """SELECT load_seq, CASE WHEN regexp_full_match(trim(availability_checked_at), '[+-]?[0-9]+(\\.[0-9]+)?') THEN CAST(CAST(trim(availability_checked_at) AS DECIMAL(20,6)) * 1000000 AS BIGINT)
 WHEN regexp_matches(trim(availability_checked_at), '(?i)(z|[+-][0-9]{2}:?[0-9]{2})$') THEN epoch_us(CAST(trim(availability_checked_at) AS TIMESTAMPTZ)) ELSE epoch_us(CAST(trim(availability_checked_at) || 'Z' AS TIMESTAMPTZ)) END AS micros FROM product_updates""")
def instants(spark, d):
    return table(spark, d, "product_updates").select("load_seq", instant_micros(F.col("availability_checked_at")).alias("micros"))


QUERIES, ORACLE = query.queries, query.oracle
