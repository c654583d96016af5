"""Queries of the scalar functions (P) over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import matching, taxonomy, text, urls
from shelfspark.plans.base import Registry
from shelfspark.session import table

query = Registry()

TOKENS = "list_sort(list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')))"


@query("fn1_tokens", f"SELECT product_id, {TOKENS.format('name')} AS tokens FROM catalog_products")
def tokens(spark, d):
    return table(spark, d, "catalog_products").select("product_id", F.array_sort(text.tokens(F.col("name"))).alias("tokens"))


_TEXT = ["name", "brand", "category", "collection", "description", "color", "material", "mounting_type", "light_source", "style", "product_family", "system", "series", "voltage"]
_PRODUCT_TEXT = "concat_ws(' ', " + ", ".join(f"nullif(CAST({c} AS VARCHAR), '')" for c in _TEXT) + ", nullif(array_to_string(list_transform(list_sort(map_keys(attributes)), lambda k: k || ' ' || attributes[k]), ' '), ''))"


def product_text():
    return text.joined([*[F.col(c).cast("string") for c in _TEXT], text.attribute_text(F.col("attributes"))])


@query("fn2_product_text", f"SELECT product_id, {_PRODUCT_TEXT} AS product_text FROM catalog_products")
def products_text(spark, d):
    return table(spark, d, "catalog_products").select("product_id", product_text().alias("product_text"))


_RECORD = ["product_url", "category", "category_url", "title", "sku", "brand"]


@query("fn3_record_text", "SELECT supplier, product_url, discovered_at, lower(concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in _RECORD) + ")) AS record_text FROM inventory_records")
def records_text(spark, d):
    return table(spark, d, "inventory_records").select("supplier", "product_url", "discovered_at", text.record_text([F.col(c) for c in _RECORD]).alias("record_text"))


@query("fn4_keys", """SELECT product_id, regexp_replace(lower(sku), '[^0-9a-zа-яё]+', '', 'g') AS sku_key, regexp_replace(lower(sku), '[^\\p{L}\\p{N}]+', '', 'g') AS alnum_key,
regexp_replace(lower(sku), '[^\\p{L}\\p{N}_]+', '', 'g') AS word_key, trim(regexp_replace(lower(sku), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS spaced_key FROM catalog_products""")
def keys(spark, d):
    s = F.col("sku")
    return table(spark, d, "catalog_products").select("product_id", text.sku_key(s).alias("sku_key"), text.alnum_key(s).alias("alnum_key"), text.word_key(s).alias("word_key"), text.spaced_key(s).alias("spaced_key"))


@query("fn5_strip_tags", """SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), '') AS cleaned FROM documents""")
def strip_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_tags(F.col("text")).alias("cleaned"))


_NUM = "TRY_CAST(replace(regexp_replace(regexp_extract(replace({0}, chr(160), ' '), '[0-9]+(?:[ \\t\\n\\x0B\\f\\r.,][0-9]+)?'), '[ \\t\\n\\x0B\\f\\r]', '', 'g'), ',', '.') AS DOUBLE)"


@query("fn6_first_number", f"SELECT product_id, {_NUM.format('name')} AS number, TRY_CAST(regexp_extract(name, '[0-9]+') AS BIGINT) AS integer_no FROM catalog_products")
def first_number(spark, d):
    return table(spark, d, "catalog_products").select("product_id", text.first_number(F.col("name")).alias("number"), text.first_integer(F.col("name")).alias("integer_no"))


_DIM = "'(?i)([0-9]+(?:[ \\t\\n\\x0B\\f\\r.,][0-9]+)?)[ \\t\\n\\x0B\\f\\r]*(мм|mm|см|cm|м|m)?(?:[^\\p{L}\\p{N}_]|$)'"


@query("fn7_dimension_mm", f"""SELECT product_id, {_NUM.format(f"regexp_extract(dimensions, {_DIM}, 1)")} *
 CASE WHEN lower(regexp_extract(dimensions, {_DIM}, 2)) IN ('см', 'cm') THEN 10 WHEN lower(regexp_extract(dimensions, {_DIM}, 2)) IN ('м', 'm') THEN 1000 ELSE 1 END AS mm FROM catalog_products""")
def dimension_mm(spark, d):
    return table(spark, d, "catalog_products").select("product_id", text.dimension_mm(F.col("dimensions")).alias("mm"))


_P = "'^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$'"
_PATH = f"regexp_extract(product_url, {_P}, 3)"
_PARTS = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"


@query("fn10_url_parts", f"""SELECT supplier, product_url, discovered_at, lower(regexp_extract(product_url, {_P}, 1)) AS scheme, regexp_replace(lower(regexp_extract(product_url, {_P}, 2)), '^www\\.', '') AS host,
 regexp_extract(product_url, {_P}, 1) || '://' || regexp_extract(product_url, {_P}, 2) || CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END || regexp_extract(product_url, {_P}, 4) AS canonical,
 CASE WHEN len({_PARTS}) >= 2 THEN {_PARTS}[-2] END AS category FROM inventory_records""")
def url_parts(spark, d):
    u = F.col("product_url")
    return table(spark, d, "inventory_records").select("supplier", "product_url", "discovered_at", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.canonical(u).alias("canonical"), urls.category(u).alias("category"))


@query("fn11_sku_from_url", f"""SELECT supplier, product_url, discovered_at, regexp_extract_all(regexp_replace({_PARTS}[-1], '(?i)\\.(html?|php)$', ''), '[A-Za-zА-Яа-я]{{1,10}}[-_]?[0-9]{{2,}}[A-Za-zА-Яа-я0-9_-]*|[0-9]{{4,}}')[-1] AS url_sku FROM inventory_records""")
def sku_from_url(spark, d):
    return table(spark, d, "inventory_records").select("supplier", "product_url", "discovered_at", urls.sku(F.col("product_url")).alias("url_sku"))


@query("fn12_taxonomy", f"SELECT product_id, {taxonomy.sql_classify('concat_ws(chr(32), name, category, canonical_url)')} AS family FROM catalog_products")
def families(spark, d):
    return table(spark, d, "catalog_products").select("product_id", taxonomy.classify(F.concat_ws(" ", "name", "category", "canonical_url")).alias("family"))


_COMPATIBLE = " OR ".join(f"(a = '{a}' AND b = '{b}') OR (a = '{b}' AND b = '{a}')" for a, b in taxonomy.COMPATIBLE) + " OR " + " OR ".join(f"(a = '{a}' AND b = '{b}')" for a, b in taxonomy.ONE_WAY)


@query("fn13_family_relation", f"""WITH p AS (SELECT s.candidate_id, coalesce(r.taxonomy_family, 'unknown') AS a, coalesce(c.product_family, 'unknown') AS b FROM scored_candidates s JOIN requirements r ON s.requirement_id = r.id JOIN catalog_products c ON s.product_id = c.product_id)
SELECT candidate_id, a AS wanted, b AS offered, CASE WHEN a = b AND a <> 'unknown' THEN 'exact' WHEN a = 'unknown' OR b = 'unknown' THEN 'unknown' WHEN {_COMPATIBLE} THEN 'compatible' ELSE 'incompatible' END AS relation FROM p""")
def family_relation(spark, d):
    """The theta condition on two families becomes an equi-join with the table of all pairs."""
    wanted = table(spark, d, "requirements").select(F.col("id").alias("requirement_id"), F.coalesce("taxonomy_family", F.lit("unknown")).alias("wanted"))
    offered = table(spark, d, "catalog_products").select("product_id", F.coalesce("product_family", F.lit("unknown")).alias("offered"))
    pairs = table(spark, d, "scored_candidates").select("candidate_id", "requirement_id", "product_id").join(wanted, "requirement_id").join(offered, "product_id")
    known = F.broadcast(taxonomy.relation_table(spark))  # the square of a fixed list of families
    return pairs.join(known, ["wanted", "offered"], "left").select("candidate_id", "wanted", "offered", F.coalesce("relation", F.when((F.col("wanted") == "unknown") | (F.col("offered") == "unknown"), "unknown").when(F.col("wanted") == F.col("offered"), "exact").otherwise("incompatible")).alias("relation"))


@query("fn20_capability", """SELECT i.supplier, i.product_url, i.discovered_at, coalesce(c.availability_mode, 'stock_tracked') AS mode FROM inventory_records i LEFT JOIN supplier_capability c
 ON i.supplier = c.host OR ends_with(i.supplier, '.' || c.host)""")
def capability(spark, d):
    """A host takes the entry of the longest domain it belongs to; the suffix test is an equi-join
    on the host's parent domains, found once per distinct host."""
    rules = table(spark, d, "supplier_capability").select(F.col("host").alias("domain"), "availability_mode")
    records = table(spark, d, "inventory_records").select("supplier", "product_url", "discovered_at")
    domains = records.select("supplier").distinct().select("supplier", F.posexplode(urls.host_suffixes(F.col("supplier"))).alias("at", "domain"))
    modes = domains.join(rules, "domain").groupBy("supplier").agg(F.min_by("availability_mode", "at").alias("mode"))
    return records.join(modes, "supplier", "left").select("supplier", "product_url", "discovered_at", F.coalesce("mode", F.lit("stock_tracked")).alias("mode"))


def _pairs(spark, d):
    wanted = table(spark, d, "requirements").select(F.col("id").alias("requirement_id"), F.col("color").alias("wanted_color"), F.col("shape").alias("wanted_shape"), F.col("mounting").alias("wanted_mounting"), "exact_dimensions", "technical_constraints")
    offered = table(spark, d, "catalog_products").select("product_id", "name", "color", "mounting_type", "ip_rating", "width_mm", "height_mm", "length_mm", "diameter_mm", "depth_mm")
    return table(spark, d, "scored_candidates").select("candidate_id", "requirement_id", "product_id").join(wanted, "requirement_id").join(offered, "product_id")


_JOINED = "scored_candidates s JOIN requirements r ON s.requirement_id = r.id JOIN catalog_products c ON s.product_id = c.product_id"


@query("fn22_field_match", f"""WITH t AS (SELECT candidate_id, {TOKENS.format('r.mounting')} AS w, {TOKENS.format('coalesce(c.mounting_type, c.name)')} AS o FROM {_JOINED})
SELECT candidate_id, CASE WHEN len(w) = 0 THEN 0.55 WHEN len(o) = 0 THEN 0.25 ELSE least(1.0, CAST(len(list_intersect(w, o)) AS DOUBLE) / len(w) * 1.15) END AS mounting_match FROM t""")
def field_match(spark, d):
    return _pairs(spark, d).select("candidate_id", matching.field_match(F.col("wanted_mounting"), F.coalesce("mounting_type", "name")).alias("mounting_match"))


def _sql_colours(c: str) -> str:
    groups = ", ".join("CASE WHEN list_has_any({t}, [{w}]) THEN '{k}' END".format(t=TOKENS.format(c), w=", ".join(f"'{x}'" for x in ws), k=k) for k, ws in matching.COLOUR_GROUPS.items())
    return f"list_filter([{groups}], lambda x: x IS NOT NULL)"


@query("fn23_colour_relation", f"""WITH t AS (SELECT candidate_id, {_sql_colours('r.color')} AS w, {_sql_colours('c.color')} AS o FROM {_JOINED})
SELECT candidate_id, CASE WHEN len(w) = 0 THEN 'not_required' WHEN len(o) = 0 THEN 'unknown' WHEN list_has_any(w, o) THEN 'match' ELSE 'mismatch' END AS relation,
 CAST(CASE WHEN len(w) = 0 THEN 0.55 WHEN len(o) = 0 THEN 0.40 WHEN list_has_any(w, o) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS color_match FROM t""")
def colour_relation(spark, d):
    relation = matching.colour_relation(F.col("wanted_color"), F.col("color"))
    score = F.create_map(*[F.lit(x) for kv in matching.COLOUR_SCORES.items() for x in kv])
    return _pairs(spark, d).select("candidate_id", relation.alias("relation")).withColumn("color_match", F.element_at(score, F.col("relation")))


_AXES = ["width", "height", "length", "diameter", "depth"]
_ACTUAL = "CASE regexp_replace(k, '_mm$', '') " + " ".join(f"WHEN '{a}' THEN c.{a}_mm" for a in _AXES) + " END"
_CLOSE = "CASE WHEN {a} IS NULL THEN 0.35 ELSE greatest(0.0, 1.0 - least(abs({a} - r.exact_dimensions[k]) / greatest(r.exact_dimensions[k], 1.0), 1.0)) END".format(a=_ACTUAL)


@query("fn24_dimension_match", f"""SELECT candidate_id, round(CASE WHEN r.exact_dimensions IS NULL OR cardinality(r.exact_dimensions) = 0 THEN 0.55 ELSE
 list_avg(list_transform(map_keys(r.exact_dimensions), lambda k: {_CLOSE})) END, 6) AS dimension_match FROM {_JOINED}""")
def dimension_match(spark, d):
    offered = {a: F.col(f"{a}_mm") for a in _AXES}
    return _pairs(spark, d).select("candidate_id", F.round(matching.dimension_match(F.col("exact_dimensions"), offered), 6).alias("dimension_match"))


@query("fn25_technical_status", f"""WITH t AS (SELECT candidate_id, lower(array_to_string(r.technical_constraints, ' ')) AS w, TRY_CAST(regexp_extract(array_to_string(r.technical_constraints, ' '), '(?i)\\bIP\\s*([0-9]{{2}})\\b', 1) AS INT) AS need,
 TRY_CAST(regexp_extract(c.ip_rating, '(?i)\\bIP\\s*([0-9]{{2}})\\b', 1) AS INT) AS have FROM {_JOINED})
SELECT candidate_id, CASE WHEN w IS NULL OR NOT regexp_matches(w, 'влажн|сануз|ip') THEN 'not_required' WHEN have IS NULL THEN 'requires_ip_check' WHEN have < need THEN 'explicit_mismatch' ELSE 'verified' END AS status FROM t""")
def technical_status(spark, d):
    return _pairs(spark, d).select("candidate_id", matching.technical_status(F.col("technical_constraints"), F.col("ip_rating")).alias("status"))


_L = f"lower({_PATH})"


@query("fn28_url_score", f"""WITH t AS (SELECT supplier, product_url, discovered_at, {_L} AS p FROM inventory_records), s AS (SELECT *, 6 * CAST(regexp_matches(p, '/store/|/product|/tovar|/item|\\.html') AS BIGINT) + 4 * CAST(regexp_matches(p, '[a-z]{{2,}}[0-9]{{3,}}|[0-9]{{5,}}') AS BIGINT)
 + least(length(p) - length(replace(p, '/', '')), 4) - 2 * CAST(regexp_matches(p, '/about/|/news/|/blog/|/catalog/') AS BIGINT) - 4 * CAST(regexp_matches(p, '(/|/catalog|/store)$') AS BIGINT) AS score FROM t)
SELECT supplier, product_url, discovered_at, CAST(score AS BIGINT) AS score, NOT regexp_matches(p, '/about/|/news/|/blog/|/article/|/search|/filter') AND NOT regexp_matches(p, '(/|\\.xml|\\.jpg|\\.png|\\.webp)$') AND (score >= 6 OR regexp_matches(p, '(?:/[a-zа-я-]{{2,}}[0-9]{{3,}}|/[0-9]{{5,}})(?:/|$)')) AS is_product FROM s""")
def url_score(spark, d):
    u = F.col("product_url")
    return table(spark, d, "inventory_records").select("supplier", "product_url", "discovered_at", urls.product_score(u).alias("score"), urls.is_product(u).alias("is_product"))


@query("fn32_candidate_id", "SELECT product_id, substr(sha256(concat_ws('|', canonical_url, name)), 1, 16) AS candidate_key FROM catalog_products")
def candidate_id(spark, d):
    return table(spark, d, "catalog_products").select("product_id", text.sha_id([F.col("canonical_url"), F.col("name")]).alias("candidate_key"))


@query("fn33_requirement_text", "SELECT id, concat_ws('. ', " + ", ".join(f"nullif({c}, '')" for c in ("fixture_type", "visual_description", "color", "shape", "mounting")) + ") AS query_text FROM requirements")
def requirement_text(spark, d):
    return table(spark, d, "requirements").select("id", text.joined([F.col(c) for c in ("fixture_type", "visual_description", "color", "shape", "mounting")], ". ").alias("query_text"))


@query("fn34_url_has_sku", """WITH t AS (SELECT supplier, product_url, discovered_at, regexp_replace(lower(sku), '[^0-9a-zа-яё]+', '', 'g') AS s, regexp_replace(lower(product_url), '[^0-9a-zа-яё]+', '', 'g') AS u FROM inventory_records)
SELECT supplier, product_url, discovered_at, s <> '' AND contains(u, s) AS has_sku FROM t""")
def url_has_sku(spark, d):
    return table(spark, d, "inventory_records").select("supplier", "product_url", "discovered_at", urls.contains_sku(F.col("product_url"), F.col("sku")).alias("has_sku"))


@query("fn37_normalized_product", """SELECT product_id, coalesce(nullif(availability_source_text, ''), availability) AS availability_source_text, coalesce(width_mm, width) AS width_mm, coalesce(height_mm, height) AS height_mm,
 coalesce(diameter_mm, diameter) AS diameter_mm, coalesce(depth_mm, depth) AS depth_mm FROM catalog_products""")
def normalized_product(spark, d):
    p = table(spark, d, "catalog_products")
    return p.select("product_id", F.coalesce(text.truthy(F.col("availability_source_text")), F.col("availability")).alias("availability_source_text"), *[F.coalesce(f"{a}_mm", a).alias(f"{a}_mm") for a in ("width", "height", "diameter", "depth")])


@query("fn38_records_from_urls", f"""SELECT DISTINCT regexp_replace(lower(regexp_extract(product_url, {_P}, 2)), '^www\\.', '') AS supplier, product_url, CASE WHEN len({_PARTS}) >= 2 THEN {_PARTS}[-2] END AS category,
 CASE WHEN len({_PARTS}) >= 2 THEN regexp_extract(product_url, {_P}, 1) || '://' || regexp_extract(product_url, {_P}, 2) || '/' || array_to_string({_PARTS}[1:-3], '/') END AS category_url FROM inventory_records""")
def records_from_urls(spark, d):
    u = F.col("product_url")
    parts = urls.path_parts(u)
    base = F.concat(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/"))
    return table(spark, d, "inventory_records").select(urls.host(u).alias("supplier"), "product_url", urls.category(u).alias("category"), F.when(F.size(parts) >= 2, base).alias("category_url")).distinct()


@query("fn40_clean_blank", """SELECT product_id, nullif(trim(regexp_replace(replace(name, chr(160), ' '), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), '') AS cleaned FROM catalog_products""")
def clean_blank(spark, d):
    return table(spark, d, "catalog_products").select("product_id", text.clean_blank(F.col("name")).alias("cleaned"))


QUERIES, ORACLE = query.queries, query.oracle
