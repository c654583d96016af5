"""Queries of vector and text search, evaluation, pages and streams.

Vector searches ask every row of ``embeddings`` whose id is divisible by 100 against all rows.
Four neighbouring ids stand for the images of one product, a label for a requirement whose query
vectors are its crops.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import evaluate, pages, ranking, search, vectors
from shelfspark.plans.base import Registry
from shelfspark.session import shared_dir, table
from shelfspark.streaming import upserts

query = Registry()

_V = "list_transform({0}, lambda x: CAST(x AS DOUBLE))"
_N = "greatest(sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 1e-12)"
_COS = f"round(list_inner_product({_V.format('q.embedding')}, {_V.format('c.embedding')}) / ({_N.format('q.embedding')} * {_N.format('c.embedding')}), 12)"
_SIMS = f"SELECT q.vec_id AS query_id, q.label AS label, c.vec_id AS vec_id, c.label AS found_label, c.vec_id // 4 AS product, {_COS} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0"


def _top(k: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank_no FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"


def _corpus(spark, d):
    return table(spark, d, "embeddings").withColumn("product", F.floor(F.col("vec_id") / 4).cast("long"))


def _asked(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0")


def _ranked(spark, d, k):
    return vectors.search(table(spark, d, "embeddings"), _asked(spark, d), "vec_id", "embedding", k)


@query("r1_cosine_topk", f"WITH s AS ({_SIMS}), t AS ({_top(20)}) SELECT query_id, vec_id, rank_no, round(score, 6) AS score FROM t")
def cosine_topk(spark, d):
    return _ranked(spark, d, 20).select("query_id", "vec_id", "rank_no", F.round("score", 6).alias("score"))


@query("r1_cosine_pairs", f"SELECT q.vec_id AS vec_id, round({_COS}, 6) AS cosine FROM embeddings q JOIN embeddings c ON c.vec_id = q.vec_id + 1")
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def _grouped(agg: str, k: int, mix: float | None = None) -> str:
    image = "a.score" if mix is None else f"round({1 - mix} * a.raw + {mix} * t.raw, 12)"
    join = "" if mix is None else "JOIN (SELECT label, vec_id, arg_min(score, query_id) AS raw FROM s GROUP BY label, vec_id) t USING (label, vec_id)"
    return f"""WITH s AS ({_SIMS}), a AS (SELECT label, vec_id, product, round({agg}(score), 12) AS score, {agg}(score) AS raw FROM s GROUP BY ALL), i AS (SELECT label, product, vec_id, {image} AS score FROM a {join}),
p AS (SELECT label, product, max(score) AS score, arg_min(vec_id, struct_pack(a := -score, b := vec_id)) AS best_image FROM i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, product) AS rank_no FROM p)
SELECT label, product, round(score, 6) AS score, best_image, rank_no FROM r WHERE rank_no <= {k}"""


def _by_label(spark, d, mode="max", text=None, weight=0.15):
    found = vectors.grouped_search(_corpus(spark, d), _asked(spark, d), "label", "embedding", "product", "vec_id", 20, mode, text, weight)
    return found.withColumn("score", F.round("score", 6))


@query("r2_max_query", _grouped("max", 20))
def max_query(spark, d):
    return _by_label(spark, d)


@query("a17_mean_query", _grouped("avg", 20))
def mean_query(spark, d):
    return _by_label(spark, d, "mean")


@query("r3_text_mix", _grouped("max", 20, 0.15))
def text_mix(spark, d):
    """The first query vector of a label stands for its text."""
    text = _asked(spark, d).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return _by_label(spark, d, "max", text)


@query("a16_product_max", f"WITH s AS ({_SIMS}), t AS ({_top(100)}) SELECT query_id, product, round(max(score), 6) AS score, arg_min(vec_id, struct_pack(a := -score, b := vec_id)) AS best_image FROM t GROUP BY query_id, product")
def product_max(spark, d):
    hits = _ranked(spark, d, 100).withColumn("product", F.floor(F.col("vec_id") / 4).cast("long"))
    return vectors.per_product(hits, "query_id", "product", "score", "vec_id").withColumn("score", F.round("score", 6))


@query("r8_gallery_max", f"""WITH s AS ({_SIMS}), p AS (SELECT query_id, product, max(score) FILTER (WHERE vec_id % 4 = 0) AS primary_score, max(score) FILTER (WHERE vec_id % 4 <> 0) AS gallery_score FROM s GROUP BY ALL),
r AS (SELECT *, greatest(coalesce(primary_score, -2), coalesce(gallery_score, -2)) AS score FROM p) SELECT query_id, product, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product) AS rank_no FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product) <= 20""")
def gallery_max(spark, d):
    """A product's score is its primary image's or its best gallery image's, whichever is more."""
    queries = _asked(spark, d).select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.grouped_search(_corpus(spark, d), queries, "query_id", "embedding", "product", "vec_id", 20)
    return found.select("query_id", "product", F.round("score", 6).alias("score"), "rank_no")


_HALF = f"round(list_inner_product({_V.format('q.embedding[1:32]')}, {_V.format('c.embedding[1:32]')}) / ({_N.format('q.embedding[1:32]')} * {_N.format('c.embedding[1:32]')}), 12)"


@query("w9_rerank", f"""WITH s AS ({_SIMS}), t AS ({_top(50)}), h AS (SELECT t.query_id, t.vec_id, t.rank_no AS old_rank, {_HALF} AS score FROM t JOIN embeddings q ON q.vec_id = t.query_id JOIN embeddings c ON c.vec_id = t.vec_id)
SELECT query_id, vec_id, old_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank_no FROM h""")
def rerank(spark, d):
    """The first 50 in the order of a second embedding (the first half of the vector)."""
    first = _ranked(spark, d, 50).select("query_id", "vec_id", F.col("rank_no").alias("old_rank"))
    half = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("half"))
    both = first.join(half, "vec_id").join(half.select(F.col("vec_id").alias("query_id"), F.col("half").alias("asked")), "query_id")
    scored = both.withColumn("score", F.round(vectors.cosine(F.col("asked"), F.col("half")), 12))
    return ranking.top_k(scored, ["query_id"], [F.col("score").desc(), F.col("old_rank")], 50).select("query_id", "vec_id", "old_rank", "rank_no")


@query("r11_pool", """WITH q AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT q.query_id, e.vec_id, sha256(concat_ws('|', 'controlled-v1', q.query_id, e.vec_id)) AS h FROM q JOIN embeddings e USING (label) WHERE e.vec_id <> q.query_id),
p AS (SELECT query_id, vec_id FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY h, vec_id) <= 19 UNION ALL SELECT query_id, query_id FROM q)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY sha256(concat_ws('|', 'fixed-pool-v1', query_id, vec_id))) AS pool_index FROM p""")
def pool(spark, d):
    """A fixed pool of 20 per query: its own positive and a hash sample of its family."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    family = e.join(q, "label").filter("vec_id <> query_id").select("query_id", "vec_id")
    sample = ranking.hash_sample(family, ["query_id"], F.col("vec_id"), "controlled-v1", 19).select("query_id", "vec_id")
    both = sample.unionByName(q.select("query_id", F.col("query_id").alias("vec_id")))
    return ranking.hash_sample(both, ["query_id"], F.col("vec_id"), "fixed-pool-v1", 20).withColumnRenamed("rank_no", "pool_index")


_FIRST = f"WITH s AS ({_SIMS}), t AS ({_top(100)}), j AS (SELECT e.vec_id AS query_id, e.label, (SELECT min(rank_no) FROM t WHERE t.query_id = e.vec_id AND t.found_label = e.label AND t.vec_id <> e.vec_id) AS rank_no FROM embeddings e WHERE e.vec_id % 100 = 0)"


def _target_ranks(spark, d):
    """Per query the rank of the first other row of its label; null beyond 100."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    hits = _ranked(spark, d, 100).filter("vec_id <> query_id").join(e.select("vec_id", F.col("label").alias("found")), "vec_id")
    targets = _asked(spark, d).select(F.col("vec_id").alias("query_id"), "label")
    right = targets.join(hits, "query_id", "left").groupBy("query_id", "label").agg(F.min(F.when(F.col("found") == F.col("label"), F.col("rank_no"))).alias("rank_no"))
    return right


@query("j8_rank_lookup", f"{_FIRST} SELECT query_id, label, rank_no FROM j")
def rank_lookup(spark, d):
    return _target_ranks(spark, d)


_METRICS = "count(*) AS targets, count(rank_no) AS found, " + ", ".join(f"round(count_if(rank_no <= {k}) / count(*), 6) AS recall_at_{k}" for k in evaluate.CUTS) + ", round(sum(coalesce(1.0 / rank_no, 0.0)) / count(*), 6) AS mrr, CAST(median(rank_no) AS DOUBLE) AS median_rank"


@query("a14_metrics", f"{_FIRST} SELECT {_METRICS} FROM j")
def metrics(spark, d):
    return evaluate.metric_summary(_target_ranks(spark, d), "rank_no", [])


@query("a15_metrics_by_label", f"{_FIRST} SELECT label, {_METRICS} FROM j GROUP BY label")
def metrics_by_label(spark, d):
    return evaluate.metric_summary(_target_ranks(spark, d), "rank_no", ["label"])


_STAGES = """WITH t AS (SELECT c.product_id, c.supplier, c.canonical_url IN (SELECT canonical_url FROM inventory_records) AS inventoried, c.product_id IN (SELECT product_id FROM scored_candidates) AS scored,
 c.product_id IN (SELECT product_id FROM scored_candidates WHERE visual_review_status <> 'unreviewed') AS reviewed, c.sku IS NOT NULL AS matchable FROM catalog_products c)"""


def _stages(spark, d):
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    s = table(spark, d, "scored_candidates")
    c = table(spark, d, "catalog_products").select("product_id", "supplier", "canonical_url", F.col("sku").isNotNull().alias("matchable"))
    c = c.join(flag(table(spark, d, "inventory_records"), "canonical_url", "inventoried"), "canonical_url", "left").join(flag(s, "product_id", "scored"), "product_id", "left")
    c = c.join(flag(s.filter("visual_review_status <> 'unreviewed'"), "product_id", "reviewed"), "product_id", "left")
    return c.fillna(False, ["inventoried", "scored", "reviewed"])


@query("a8_stage_recall", _STAGES + " SELECT supplier, count(*) AS targets, " + ", ".join(f"count_if({c}) AS {c}, round(count_if({c}) / count(*), 6) AS {c}_recall" for c in ("matchable", "inventoried", "scored", "reviewed")) + " FROM t GROUP BY supplier")
def stage_recall(spark, d):
    return evaluate.stage_recall(_stages(spark, d), ["supplier"], {c: F.col(c) for c in ("matchable", "inventoried", "scored", "reviewed")})


@query("e4_diagnosis", _STAGES + " SELECT product_id, CASE WHEN NOT matchable THEN 'not_matchable' WHEN NOT inventoried THEN 'inventory_miss' WHEN NOT scored THEN 'hydration_miss' WHEN NOT reviewed THEN 'review_incomplete' ELSE 'retrieved' END AS diagnosis FROM t")
def diagnosis(spark, d):
    steps = [("not_matchable", ~F.col("matchable")), ("inventory_miss", ~F.col("inventoried")), ("hydration_miss", ~F.col("scored")), ("review_incomplete", ~F.col("reviewed"))]
    return _stages(spark, d).select("product_id", evaluate.diagnosis(steps, "retrieved").alias("diagnosis"))


_ASK = "CAST(regexp_extract(id, '[0-9]+') AS BIGINT) % 100 = 0"
_W = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"


@query("r9_bm25", f"""WITH q AS (SELECT id AS requirement_id, unnest(list_distinct({_W.format('fixture_type')})) AS w FROM requirements WHERE {_ASK}), d AS (SELECT product_id, {_W.format("concat_ws(' ', name, category, collection)")} AS ws FROM catalog_products),
st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d), h AS (SELECT product_id, len(ws) AS len, unnest(ws) AS w FROM d), tf AS (SELECT product_id, len, w, count(*) AS tf FROM h WHERE w IN (SELECT w FROM q) GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
sc AS (SELECT q.requirement_id, tf.product_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * tf.len / st.mean))), 9) AS score, count(*) AS have FROM tf JOIN df USING (w) JOIN q USING (w), st GROUP BY ALL),
nd AS (SELECT requirement_id, count(*) AS need FROM q GROUP BY 1) SELECT requirement_id, product_id, round(score, 6) AS score, row_number() OVER (PARTITION BY requirement_id ORDER BY score DESC, product_id) AS rank_no FROM sc JOIN nd USING (requirement_id) WHERE have = need QUALIFY row_number() OVER (PARTITION BY requirement_id ORDER BY score DESC, product_id) <= 50""")
def bm25(spark, d):
    """Every requirement whose number is divisible by 100 against all products."""
    asked = table(spark, d, "requirements").filter(F.regexp_extract("id", "[0-9]+", 0).try_cast("bigint") % 100 == 0)
    corpus = table(spark, d, "catalog_products").select("product_id", F.concat_ws(" ", "name", "category", "collection").alias("doc"))
    return search.bm25(corpus, "product_id", "doc", asked, "id", "fixture_type", 50).select(F.col("id").alias("requirement_id"), "product_id", F.round("score", 6).alias("score"), "rank_no")


# Pages: the catalogue's rows written as pages and sitemaps, then read again; pages of other makes
# are in tests/test_pages.py -------------------------------------------------------------------
def _pages(spark, d):
    p = table(spark, d, "catalog_products")
    offer = F.struct("price", F.col("currency").alias("priceCurrency"), "availability")
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), "name", "sku", F.struct(F.col("brand").alias("name")).alias("brand"), offer.alias("offers"), F.slice("image_urls", 1, 1).alias("image")))
    row = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<tr><th>{name}</th><td>"), F.format_string("%.1f", c), F.lit(" мм</td></tr>")))
    specs = F.concat_ws("", row("Высота упаковки", "depth_mm"), F.lit("<tr><th>Package height<td>9999 mm</tr>"), row("Высота", "height_mm"), row("Диаметр", "diameter_mm"))
    gallery = F.array_join(F.transform("image_urls", lambda u: F.concat(F.lit("<li><img data-src='"), u, F.lit("'></li>"))), "")
    near = F.concat(F.lit("<ul class=gallery>"), gallery, F.lit("<img src=/logo.png></ul><div class='recommend gallery'><img src=/other.jpg></div>"))
    body = F.concat(F.lit('<body><a href="/about#x">a</a><a href="'), "source_url", F.lit('">b</a>'), near, F.lit("<table>"), specs, F.lit("</table><br></body>"))
    return p.select("product_id", F.col("canonical_url").alias("url"), F.concat(F.lit('<html><head><script type="application/ld+json">'), ld, F.lit("</script></head>"), body).alias("html"))


_CLEAN = "nullif(trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')), '')"


@query("x1_page_fields", f"""WITH c AS (SELECT *, {_CLEAN.format('name')} AS n, {_CLEAN.format('sku')} AS k FROM catalog_products)
SELECT product_id, n IS NOT NULL AS is_product, n[:240] AS name, CASE WHEN n IS NOT NULL AND NOT contains(k, ' ') AND length(k) <= 40 THEN k END AS sku, CASE WHEN n IS NOT NULL THEN {_CLEAN.format('brand')} END AS brand,
CASE WHEN n IS NOT NULL THEN price END AS price, CASE WHEN n IS NOT NULL THEN {_CLEAN.format('currency')} END AS currency, CASE WHEN n IS NOT NULL THEN {_CLEAN.format('availability')} END AS availability,
CASE WHEN n IS NOT NULL THEN CAST(printf('%.1f', height_mm) AS DOUBLE) END AS height_mm, CASE WHEN n IS NOT NULL THEN CAST(printf('%.1f', diameter_mm) AS DOUBLE) END AS diameter_mm,
CASE WHEN n IS NOT NULL THEN len(list_distinct(image_urls[:12])) ELSE 0 END AS images, CASE WHEN n IS NOT NULL AND len(image_urls) > 0 THEN 'jsonld' END AS image_source FROM c""")
def page_fields(spark, d):
    got = pages.parse_pages(_pages(spark, d), "product_id", "html", "url")
    return got.select("product_id", "is_product", "name", "sku", "brand", "price", "currency", "availability", "height_mm", "diameter_mm", F.coalesce(F.size("image_urls"), F.lit(0)).cast("long").alias("images"), "image_source")


@query("x2_links", """SELECT product_id, unnest(list_distinct([regexp_extract(canonical_url, '^(https?://[^/]+)', 1) || '/about', regexp_replace(source_url, '#.*$', '')])) AS link FROM catalog_products""")
def links(spark, d):
    return pages.link_urls(_pages(spark, d), "product_id", "url", "html").select("product_id", "link")


@query("s13_sitemap_locations", "SELECT DISTINCT category_url, product_url AS location FROM inventory_records WHERE category_url IS NOT NULL")
def sitemap_locations(spark, d):
    loc = F.concat(F.lit("<url><loc> "), F.replace("product_url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    maps = table(spark, d, "inventory_records").filter("category_url is not null").groupBy("supplier", "category_url", F.pmod(F.xxhash64("product_url"), F.lit(1024))).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("xml"))
    return pages.sitemap_locations(maps, "category_url", "xml").distinct()


_EDGES = "SELECT DISTINCT supplier AS parent, category_url AS child FROM inventory_records WHERE category_url IS NOT NULL UNION SELECT DISTINCT category_url, canonical_url FROM inventory_records WHERE category_url IS NOT NULL"


@query("s14_crawl", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT DISTINCT supplier AS url, 0 AS depth FROM inventory_records UNION SELECT e.child, r.depth + 1 FROM r JOIN e ON r.url = e.parent) SELECT url, CAST(min(depth) AS INT) AS depth FROM r GROUP BY url")
def crawl(spark, d):
    i = table(spark, d, "inventory_records").filter("category_url is not null")
    edges = i.select(F.col("supplier").alias("parent"), F.col("category_url").alias("child")).union(i.select("category_url", "canonical_url")).distinct()
    return pages.crawl(edges, table(spark, d, "inventory_records").select(F.col("supplier").alias("url")))


@query("k6_report", """WITH b AS (SELECT requirement_id, candidate_id, row_number() OVER (PARTITION BY requirement_id ORDER BY overall_score DESC NULLS LAST, candidate_id) AS n FROM scored_candidates WHERE requirement_id IS NOT NULL)
SELECT r.id AS requirement_id, count(b.candidate_id) AS shown, coalesce(string_agg(CAST(b.n AS VARCHAR) || ':' || CAST(b.candidate_id AS VARCHAR), ' ' ORDER BY b.n), '') AS items FROM requirements r LEFT JOIN b ON b.requirement_id = r.id AND b.n <= 5 GROUP BY r.id""")
def report(spark, d):
    """A requirement's five candidates as one document; requirements without any stay."""
    s = table(spark, d, "scored_candidates").filter("requirement_id is not null").select("requirement_id", "candidate_id", "overall_score")
    best = ranking.top_k(s, ["requirement_id"], [F.col("overall_score").desc_nulls_last(), F.col("candidate_id")], 5)
    docs = best.groupBy("requirement_id").agg(F.count("*").alias("shown"), F.array_sort(F.collect_list(F.struct("rank_no", "candidate_id"))).alias("l"))
    r = table(spark, d, "requirements").select(F.col("id").alias("requirement_id"))
    items = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["rank_no"].cast("string"), x["candidate_id"].cast("string"))), " ")
    return r.join(docs, "requirement_id", "left").select("requirement_id", F.coalesce("shown", F.lit(0)).cast("long").alias("shown"), F.coalesce(items, F.lit("")).alias("items"))


@query("st1_stream_upsert", "SELECT product_id, load_seq, availability_status, price FROM product_updates QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY load_seq DESC) = 1")
def stream_upsert(spark, d):
    """Extension: the updates as a stream, merged batch by batch."""
    where = upserts.fresh(shared_dir(spark))
    rows = table(spark, d, "product_updates")
    # two runs of the stream over a growing folder, each with a state object of its own
    for part in range(2):
        rows.filter(F.pmod(F.xxhash64("load_seq"), F.lit(2)) == part).write.mode("append").parquet(f"{where}/source")
        source = spark.readStream.schema(rows.schema).parquet(f"{where}/source")
        state = upserts.StreamState(spark, f"{where}/state", ["product_id"], ["load_seq"], ["availability_status", "price"], [])
        held = upserts.stream_upsert(source, state, f"{where}/checkpoint")
    return held.select("product_id", "load_seq", "availability_status", "price")


QUERIES, ORACLE = query.queries, query.oracle
