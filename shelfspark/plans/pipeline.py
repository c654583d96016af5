"""Queries of the pipeline's remaining joins, selections and evaluation steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import text, urls
from shelfspark.operators import ranking
from shelfspark.plans import retrieval
from shelfspark.plans.base import Registry
from shelfspark.plans.functions import _PATH, _PARTS
from shelfspark.session import table

query = Registry()

_FIRST, _SIMS, _top = retrieval._FIRST, retrieval._SIMS, retrieval._top


@query("a9_found_at", f"{_FIRST} SELECT label, count_if(rank_no <= 20) AS at_20, count_if(rank_no <= 50) AS at_50, count_if(rank_no <= 100) AS at_100 FROM j GROUP BY label")
def found_at(spark, d):
    ranks = retrieval.rank_lookup(spark, d)
    return ranks.groupBy("label").agg(*[F.count_if(F.col("rank_no") <= k).alias(f"at_{k}") for k in (20, 50, 100)])


@query("a11_items_by_category", "SELECT coalesce(product_family, 'unknown') AS family, count(*) AS items, count(DISTINCT supplier) AS suppliers, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM catalog_products GROUP BY 1")
def items_by_category(spark, d):
    p = table(spark, d, "catalog_products").select(F.coalesce("product_family", F.lit("unknown")).alias("family"), "supplier")
    counts = p.groupBy("family").agg(F.count("*").alias("items"), F.countDistinct("supplier").alias("suppliers"))
    total = counts.agg(F.sum("items").alias("total"))  # one row
    return counts.join(total, how="cross").select("family", "items", "suppliers", F.round(F.col("items") / F.col("total"), 6).alias("share"))


@query("a12_supplier_state", """WITH i AS (SELECT supplier, count(DISTINCT canonical_url) AS n FROM inventory_records GROUP BY 1), c AS (SELECT supplier, count(DISTINCT canonical_url) AS m FROM catalog_products GROUP BY 1)
SELECT i.supplier, CASE WHEN coalesce(m, 0) = 0 THEN 'broken' WHEN m * 2 >= n THEN 'healthy' ELSE 'partial' END AS state FROM i LEFT JOIN c USING (supplier)""")
def supplier_state(spark, d):
    i = table(spark, d, "inventory_records").groupBy("supplier").agg(F.countDistinct("canonical_url").alias("n"))
    c = table(spark, d, "catalog_products").groupBy("supplier").agg(F.countDistinct("canonical_url").alias("m"))
    state = F.when(F.coalesce("m", F.lit(0)) == 0, "broken").when(F.col("m") * 2 >= F.col("n"), "healthy").otherwise("partial")
    return i.join(c, "supplier", "left").select("supplier", state.alias("state"))


@query("a19_ready_by_supplier", "SELECT supplier, count(*) AS products, count_if(primary_image_url IS NOT NULL) AS ready, count_if(primary_image_url IS NULL) AS no_image FROM catalog_products GROUP BY supplier")
def ready_by_supplier(spark, d):
    image = F.col("primary_image_url")
    return table(spark, d, "catalog_products").groupBy("supplier").agg(F.count("*").alias("products"), F.count_if(image.isNotNull()).alias("ready"), F.count_if(image.isNull()).alias("no_image"))


@query("a21_scope_recall", """WITH t AS (SELECT coalesce(product_family, 'unknown') AS family, canonical_url IN (SELECT canonical_url FROM inventory_records) AS natural_hit, product_id IN (SELECT product_id FROM scored_candidates) AS oracle_hit FROM catalog_products)
SELECT family, count(*) AS targets, round(count_if(natural_hit) / count(*), 6) AS natural_recall, round(count_if(oracle_hit) / count(*), 6) AS oracle_recall FROM t GROUP BY family""")
def scope_recall(spark, d):
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    p = table(spark, d, "catalog_products").select(F.coalesce("product_family", F.lit("unknown")).alias("family"), "canonical_url", "product_id")
    p = p.join(flag(table(spark, d, "inventory_records"), "canonical_url", "n"), "canonical_url", "left").join(flag(table(spark, d, "scored_candidates"), "product_id", "o"), "product_id", "left")
    share = lambda c: F.round(F.try_divide(F.count(c), F.count("*")), 6)
    return p.groupBy("family").agg(F.count("*").alias("targets"), share("n").alias("natural_recall"), share("o").alias("oracle_recall"))


@query("a23_image_counters", "SELECT product_id, len(image_urls) AS images, len(list_filter(image_urls, lambda u: contains(u, '_1.'))) AS firsts FROM catalog_products")
def image_counters(spark, d):
    return table(spark, d, "catalog_products").select("product_id", F.size("image_urls").cast("long").alias("images"), F.size(F.filter("image_urls", lambda u: F.contains(u, F.lit("_1.")))).cast("long").alias("firsts"))


_KEY = "regexp_replace(lower({0}), '[^0-9a-zа-яё]+', '', 'g')"
_URL_SKU = f"regexp_extract_all(regexp_replace({_PARTS}[-1], '(?i)\\.(html?|php)$', ''), '[A-Za-zА-Яа-я]{{1,10}}[-_]?[0-9]{{2,}}[A-Za-zА-Яа-я0-9_-]*|[0-9]{{4,}}')[-1]"


@query("j9_sku_or_address", f"""WITH i AS (SELECT supplier, canonical_url, {_KEY.format('sku')} AS k, {_KEY.format(_URL_SKU)} AS u FROM inventory_records),
m AS (SELECT c.product_id, i.canonical_url, 0 AS how FROM catalog_products c JOIN i ON i.supplier = c.supplier AND i.k = {_KEY.format('c.sku')} AND i.k <> '' UNION ALL SELECT c.product_id, i.canonical_url, 1 FROM catalog_products c JOIN i ON i.supplier = c.supplier AND i.u = {_KEY.format('c.sku')} AND i.u <> '')
SELECT product_id, arg_min(canonical_url, struct_pack(a := how, b := canonical_url)) AS found_url, min(how) AS how FROM m GROUP BY product_id""")
def sku_or_address(spark, d):
    """The first record of the supplier with the article number, or with it in its address."""
    i = table(spark, d, "inventory_records").select("supplier", "canonical_url", text.sku_key(F.col("sku")).alias("k"), text.sku_key(urls.sku(F.col("product_url"))).alias("u"))
    keys = i.select("supplier", "canonical_url", F.explode(F.array(F.struct(F.lit(0).alias("how"), F.col("k").alias("key")), F.struct(F.lit(1).alias("how"), F.col("u").alias("key")))).alias("e")).select("supplier", "canonical_url", "e.how", "e.key").filter("key <> ''")
    best = keys.groupBy("supplier", "key").agg(F.min(F.struct("how", "canonical_url")).alias("b"))
    c = table(spark, d, "catalog_products").select("product_id", "supplier", text.sku_key(F.col("sku")).alias("key"))
    return c.join(best, ["supplier", "key"]).select("product_id", F.col("b.canonical_url").alias("found_url"), F.col("b.how").alias("how"))


@query("j11_corpus", """SELECT c.product_id, i.image_url AS found_image, CASE WHEN c.primary_image_url IS NULL AND i.image_url IS NULL THEN 'no_image' WHEN c.primary_image_url IS NULL THEN 'from_inventory' ELSE 'ready' END AS status
FROM catalog_products c LEFT JOIN (SELECT canonical_url, max(image_url) AS image_url FROM inventory_records GROUP BY 1) i USING (canonical_url)""")
def corpus(spark, d):
    i = table(spark, d, "inventory_records").groupBy("canonical_url").agg(F.max("image_url").alias("found_image"))
    status = F.when(F.col("primary_image_url").isNull() & F.col("found_image").isNull(), "no_image").when(F.col("primary_image_url").isNull(), "from_inventory").otherwise("ready")
    return table(spark, d, "catalog_products").select("product_id", "canonical_url", "primary_image_url").join(i, "canonical_url", "left").select("product_id", "found_image", status.alias("status"))


@query("j12_images_or_one", """SELECT product_id, CAST(p AS BIGINT) AS position, CASE WHEN len(image_urls) > 0 THEN image_urls[p + 1] END AS image_url FROM catalog_products, (SELECT unnest(range(64)) AS p) WHERE p < greatest(len(image_urls), 1)""")
def images_or_one(spark, d):
    """One row per image, one row without an image for products that have none."""
    return table(spark, d, "catalog_products").select("product_id", F.posexplode_outer("image_urls").alias("position", "image_url")).select("product_id", F.coalesce("position", F.lit(0)).cast("long").alias("position"), "image_url")


@query("j14_before_after", f"""WITH s AS ({_SIMS}), t AS ({_top(50)}), h AS (SELECT t.query_id, t.vec_id, t.found_label, t.label, t.rank_no AS old_rank, {retrieval._HALF} AS half FROM t JOIN embeddings q ON q.vec_id = t.query_id JOIN embeddings c ON c.vec_id = t.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY half DESC, old_rank) AS rank_no FROM h) SELECT query_id, min(old_rank) AS best_before, min(rank_no) AS best_after FROM n WHERE found_label = label AND vec_id <> query_id GROUP BY query_id""")
def before_after(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    r = retrieval.rerank(spark, d).filter("vec_id <> query_id").join(e, "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return r.filter("label = wanted").groupBy("query_id").agg(F.min("old_rank").alias("best_before"), F.min("rank_no").alias("best_after"))


@query("k10_pending_hashes", "SELECT DISTINCT sha256(primary_image_url) AS image_hash FROM catalog_products WHERE primary_image_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inventory_records i WHERE i.image_url = primary_image_url)")
def pending_hashes(spark, d):
    """Content to encode: what no cached vector stands for, each once."""
    have = table(spark, d, "inventory_records").select(F.sha2("image_url", 256).alias("image_hash"))
    want = table(spark, d, "catalog_products").filter("primary_image_url is not null").select(F.sha2("primary_image_url", 256).alias("image_hash")).distinct()
    return want.join(have, "image_hash", "left_anti")


_DENIED = "/(search|filter|cart|compare)(/|$)|[?&](sort|page)="


@query("s12_allowed", f"SELECT supplier, product_url, discovered_at FROM inventory_records WHERE NOT regexp_matches({_PATH}, '{_DENIED}')")
def allowed(spark, d):
    return table(spark, d, "inventory_records").filter(~urls.path(F.col("product_url")).rlike(_DENIED)).select("supplier", "product_url", "discovered_at")


@query("s22_category_pages", "SELECT supplier, category_url FROM (SELECT DISTINCT supplier, category_url FROM inventory_records WHERE category_url IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY length(category_url) - length(replace(category_url, '/', '')), category_url) <= 12")
def category_pages(spark, d):
    """A supplier's twelve category pages, the shallowest first."""
    c = table(spark, d, "inventory_records").filter("category_url is not null").select("supplier", "category_url").distinct()
    depth = F.length("category_url") - F.length(F.replace("category_url", F.lit("/"), F.lit("")))
    return ranking.top_k(c, ["supplier"], [depth, F.col("category_url")], 12).select("supplier", "category_url")


@query("s23_first_addresses", f"""WITH t AS (SELECT DISTINCT supplier, canonical_url FROM inventory_records WHERE {_KEY.format('sku')} <> '' AND contains({_KEY.format('title')}, {_KEY.format('sku')}))
SELECT supplier, canonical_url FROM t QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY canonical_url) <= 30""")
def first_addresses(spark, d):
    i = table(spark, d, "inventory_records").filter((text.sku_key(F.col("sku")) != "") & F.contains(text.sku_key(F.col("title")), text.sku_key(F.col("sku"))))
    return ranking.top_k(i.select("supplier", "canonical_url").distinct(), ["supplier"], [F.col("canonical_url")], 30).select("supplier", "canonical_url")


_PRIORITY = ["plafonoff.example", "lampovik.example", "candelab.example"]
_POSITION = "coalesce(nullif(list_position([" + ", ".join(f"'{p}'" for p in _PRIORITY) + "], supplier), 0), 1000)"


@query("w16_priority_order", f"SELECT supplier, row_number() OVER (ORDER BY {_POSITION}, supplier) AS place FROM (SELECT DISTINCT supplier FROM catalog_products)")
def priority_order(spark, d):
    """Preferred suppliers first; one row per supplier is ranked, whatever the catalogue's size."""
    s = table(spark, d, "catalog_products").select("supplier").distinct()
    at = F.array_position(F.array(*map(F.lit, _PRIORITY)), F.col("supplier"))
    ranked = s.select("supplier", F.coalesce(F.nullif(at, F.lit(0)), F.lit(1000)).alias("at"), F.lit(1).alias("one"))
    return ranking.top_k(ranked, ["one"], [F.col("at"), F.col("supplier")], 1_000_000, "place").select("supplier", "place")


@query("u3_union_candidates", "SELECT product_family, canonical_url FROM catalog_products WHERE product_family IS NOT NULL UNION ALL SELECT NULL, canonical_url FROM inventory_records WHERE title IS NOT NULL")
def union_candidates(spark, d):
    a = table(spark, d, "catalog_products").filter("product_family is not null").select("product_family", "canonical_url")
    return a.unionByName(table(spark, d, "inventory_records").filter("title is not null").select(F.lit(None).cast("string").alias("product_family"), "canonical_url"))


@query("u8_supplier_universe", "SELECT host AS supplier FROM supplier_capability UNION SELECT supplier FROM catalog_products UNION SELECT supplier FROM inventory_records")
def supplier_universe(spark, d):
    parts = [table(spark, d, "supplier_capability").select(F.col("host").alias("supplier")), table(spark, d, "catalog_products").select("supplier"), table(spark, d, "inventory_records").select("supplier")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("e3_targets", "SELECT id, CASE WHEN confidence >= 0.60 THEN 'primary' WHEN confidence >= 0.40 THEN 'exploratory' ELSE 'left_out' END AS class FROM requirements WHERE taxonomy_family IS NOT NULL")
def targets(spark, d):
    c = F.col("confidence")
    return table(spark, d, "requirements").filter("taxonomy_family is not null").select("id", F.when(c >= 0.60, "primary").when(c >= 0.40, "exploratory").otherwise("left_out").alias("class"))


@query("e7_violations", """SELECT requirement_id, count(*) - count(DISTINCT product_id) AS repeated, count_if(overall_score < 0 OR overall_score > 1) AS out_of_range, count_if(visual_review_status = 'rejected' AND visual_reject_reason IS NULL) AS without_reason FROM scored_candidates WHERE NOT isnan(coalesce(overall_score, 0)) GROUP BY requirement_id""")
def violations(spark, d):
    s = table(spark, d, "scored_candidates").filter(~F.isnan(F.coalesce("overall_score", F.lit(0.0))))
    return s.groupBy("requirement_id").agg(
        (F.count("*") - F.countDistinct("product_id")).alias("repeated"), F.count_if((F.col("overall_score") < 0) | (F.col("overall_score") > 1)).alias("out_of_range"),
        F.count_if((F.col("visual_review_status") == "rejected") & F.col("visual_reject_reason").isNull()).alias("without_reason"),
    )


@query("e10_first_success", """WITH t AS (SELECT canonical_url, supplier, CASE discovery_source WHEN 'sitemap' THEN 0 WHEN 'category' THEN 1 ELSE 2 END AS step, product_url, discovered_at FROM inventory_records)
SELECT canonical_url, arg_min(product_url, struct_pack(a := step, b := discovered_at, c := product_url)) AS product_url, min(step) AS step FROM t GROUP BY canonical_url""")
def first_success(spark, d):
    """The strategies in order of priority; the first that found an address holds."""
    s = F.col("discovery_source")
    t = table(spark, d, "inventory_records").select("canonical_url", "product_url", "discovered_at", F.when(s == "sitemap", 0).when(s == "category", 1).otherwise(2).alias("step"))
    return t.groupBy("canonical_url").agg(F.min_by("product_url", F.struct("step", "discovered_at", "product_url")).alias("product_url"), F.min("step").alias("step"))


@query("e12_annotation", """WITH s AS (SELECT sku, min(product_family) AS f FROM catalog_products WHERE sku IS NOT NULL AND product_family IS NOT NULL GROUP BY 1), c AS (SELECT category, min(product_family) AS f FROM catalog_products WHERE category IS NOT NULL AND product_family IS NOT NULL GROUP BY 1)
SELECT i.supplier, i.product_url, i.discovered_at, coalesce(s.f, c.f) AS family, CASE WHEN s.f IS NOT NULL THEN 'sku' WHEN c.f IS NOT NULL THEN 'category' END AS how FROM inventory_records i LEFT JOIN s ON s.sku = i.sku LEFT JOIN c ON c.category = i.category""")
def annotation(spark, d):
    p = table(spark, d, "catalog_products").filter("product_family is not null")
    by = lambda c, name: p.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("product_family").alias(name))
    i = table(spark, d, "inventory_records").select("supplier", "product_url", "discovered_at", "sku", "category").join(by("sku", "s"), "sku", "left").join(by("category", "c"), "category", "left")
    return i.select("supplier", "product_url", "discovered_at", F.coalesce("s", "c").alias("family"), F.when(F.col("s").isNotNull(), "sku").when(F.col("c").isNotNull(), "category").alias("how"))


@query("e16_reuse", """SELECT c.host AS supplier, CASE WHEN i.supplier IS NULL THEN 'to_discover' ELSE 'cached_inventory' END AS status, coalesce(i.n, 0) AS records FROM supplier_capability c LEFT JOIN (SELECT supplier, count(*) AS n FROM inventory_records GROUP BY 1) i ON c.host = i.supplier""")
def reuse(spark, d):
    i = table(spark, d, "inventory_records").groupBy("supplier").agg(F.count("*").alias("n"))
    c = table(spark, d, "supplier_capability").select(F.col("host").alias("supplier"))
    return c.join(i, "supplier", "left").select("supplier", F.when(F.col("n").isNull(), "to_discover").otherwise("cached_inventory").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("records"))


@query("e17_gallery_union", f"""WITH s AS ({_SIMS}), t AS ({_top(20)}), h AS (SELECT q.vec_id AS query_id, c.vec_id, {retrieval._HALF} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
u AS (SELECT query_id, vec_id FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20) SELECT query_id, vec_id FROM t UNION SELECT query_id, vec_id FROM u UNION SELECT vec_id, vec_id FROM embeddings WHERE vec_id % 100 = 0""")
def gallery_union(spark, d):
    """Each model's first 20 and the positive, each pair once."""
    from shelfspark.operators import vectors

    e = table(spark, d, "embeddings")
    half = e.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    a = retrieval._ranked(spark, d, 20).select("query_id", "vec_id")
    b = vectors.search(half, half.filter("vec_id % 100 = 0"), "vec_id", "embedding", 20).select("query_id", "vec_id")
    own = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vec_id")
    return a.union(b).union(own).distinct()


QUERIES, ORACLE = query.queries, query.oracle
