"""Readers of files that aren't tables."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.taxonomy import classify
from shelfspark.functions.text import first_integer, offer_price

REQUIREMENT_DDL = (
    "id string, room string, fixture_type string, quantity bigint, visual_description string, color string, shape string, mounting string, approximate_dimensions map<string,double>, exact_dimensions map<string,double>, "
    "technical_constraints array<string>, source_pages array<string>, source_refs array<struct<file:string,page:int,source_type:string,note:string,confidence:double>>, confidence double, reference_pages array<string>, "
    "reference_image_paths array<string>, reference_crop_paths array<string>, taxonomy_family string, coverage_status string, coverage_note string"
)


def suppliers(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Url of every line that isn't blank; ``only`` keeps those whose address, without scheme
    and trailing slash, is listed, letter case aside."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")
    if only is None:
        return lines
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "^[a-z]+://", ""), "/+$", "")
    wanted = [w.strip().lower().split("://")[-1].rstrip("/") for w in only]
    return lines.filter(plain(F.col("url")).isin(wanted))


def requirements(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of requirements with the declared schema; an empty family is classified
    from the texts, a missing coverage status is 'matched'."""
    df = spark.read.schema(REQUIREMENT_DDL).json(path, multiLine=True)
    text = F.concat_ws(" ", "fixture_type", "visual_description", "shape", "mounting", F.array_join("technical_constraints", " "))
    family = F.when(F.col("taxonomy_family") != "", F.col("taxonomy_family"))
    return df.withColumns({"taxonomy_family": F.coalesce(family, classify(text)), "coverage_status": F.coalesce("coverage_status", F.lit("matched"))})


def capability(spark: SparkSession, path: str) -> DataFrame:
    """S3: host and mode of a rules file; a file that can't be read gives no rule, so the caller's
    default holds; unknown modes are the strictest."""
    kind = "default_mode string, suppliers map<string,struct<mode:string,evidence:string>>"
    try:
        df = spark.read.schema(kind).option("mode", "PERMISSIVE").json(path, multiLine=True)
        rows = df.select(F.explode("suppliers").alias("host", "rule"))
    except Exception:  # noqa: BLE001 - the conservative fallback
        return spark.createDataFrame([], "host string, mode string, evidence string")
    known = F.col("rule.mode").isin("stock_tracked", "stock_not_published", "mixed")
    return rows.select("host", F.when(known, F.col("rule.mode")).otherwise("stock_tracked").alias("mode"), "rule.evidence")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _tables(content: bytes) -> list[tuple[int, int, list[str]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for t, table in enumerate(root.iter(f"{_W}tbl")):
        for r, row in enumerate(table.iter(f"{_W}tr")):
            out.append((t, r, [" ".join("".join(x.text or "" for x in c.iter(f"{_W}t")).split()) for c in row.iter(f"{_W}tc")]))
    return out


def docx_tables(spark: SparkSession, path: str) -> DataFrame:
    """Path, table_no, row_no, cells of all tables of DOCX files; a broken file gives one row
    with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(p, t, r, cells, None) for t, r, cells in _tables(content)]
                except Exception as e:  # noqa: BLE001
                    out.append((p, None, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["path", "table_no", "row_no", "cells", "error"]).astype({"table_no": "Int64", "row_no": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, table_no bigint, row_no bigint, cells array<string>, error string")


# Words in the headings of an offer's table by field; what looks like an article number,
# and what looks so but is a power, a temperature or the like.
OFFER_HEADINGS = {"position": ("№", "номер"), "name": ("наименование", "название"), "quantity": ("кол-во", "количество"), "price": ("цена",), "delivery": ("срок поставки", "поставка")}
ARTICLE = re.compile(r"(?<![A-Za-zА-Яа-я0-9])(?:[A-Za-z]{1,8}[-/]?\d[\w/-]*|\d{4,}[A-Za-z]*(?:[/,-][A-Za-z0-9]+)*)(?![A-Za-zА-Яа-я0-9])")
NO_ARTICLE = re.compile(r"led|smd2835.*|24v|4[02]00k|(?:100|200|60|300)w|ip20|[dh]\d+", re.I)
NAMED_ARTICLE = re.compile(r"артикул\W*([A-Za-zА-Яа-я]{1,8}[-/]?[\w/-]*\d[\w/-]*)", re.I)


def article(name: str) -> str | None:
    """The article number in a product's name: the one it is said to be, else the first that looks so."""
    named = NAMED_ARTICLE.search(name)
    found = next((m[0] for m in ARTICLE.finditer(name) if not NO_ARTICLE.fullmatch(m[0])), None)
    return named[1] if named and found else found


def offers(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the first table of DOCX offers: path, row_no, position, name, sku, quantity,
    price, delivery, error. Columns are told by their headings (the first is the name's if none is),
    rows without a name are left out, a missing position is the row's number. A broken file gives one
    row with the error, a file without a table none."""
    tables = docx_tables(spark, path)
    heading = tables.filter("table_no = 0 and row_no = 0").select("path", F.transform("cells", lambda c: F.lower(c)).alias("heads"))
    rows = tables.filter("table_no = 0 and row_no > 0").join(heading, "path")
    at = {f: F.array_min(F.filter(F.transform("heads", lambda h, i: F.when(h.rlike("|".join(map(re.escape, words))), i)), lambda x: x.isNotNull())) for f, words in OFFER_HEADINGS.items()}  # noqa: B023
    cell = lambda f: F.get("cells", at[f] if f != "name" else F.coalesce(at[f], F.lit(0)))
    named = rows.select("path", "row_no", *[cell(f).alias(f) for f in OFFER_HEADINGS]).filter("coalesce(name, '') <> ''")

    @F.pandas_udf("string")
    def articles(names: pd.Series) -> pd.Series:
        return names.map(article)

    done = named.select(
        "path", "row_no", F.coalesce(first_integer(F.col("position")).cast("bigint"), F.col("row_no")).alias("position"), "name", articles("name").alias("sku"),
        first_integer(F.col("quantity")).cast("bigint").alias("quantity"), offer_price(F.col("price")).alias("price"), F.nullif("delivery", F.lit("")).alias("delivery"), F.lit(None).cast("string").alias("error"),
    )
    return done.unionByName(tables.filter("error is not null").select("path", "error"), allowMissingColumns=True)


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files; none if nothing is there."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    except Exception:  # noqa: BLE001 - nothing to read
        return spark.createDataFrame([], "path string, value string")


def _parsed(files: DataFrame, rows, schema: str) -> DataFrame:
    """The rows that ``rows`` gives for each file that is a JSON object; others give none."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for text in pdf["value"]:
                try:
                    data = json.loads(text)
                except ValueError:
                    continue
                out += rows(data) if isinstance(data, dict) else []
            yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(run, schema)


def _reviewed(data: dict) -> list[tuple]:
    out = []
    asked = data.get("requirements")
    for requirement, entry in asked.items() if isinstance(asked, dict) else ():
        if not isinstance(entry, dict):
            continue
        found = entry.get("candidates", entry.get("reviews", []))
        if isinstance(found, dict):
            found = [{**(v if isinstance(v, dict) else {}), "sku": k} for k, v in found.items()]
        for r in found if isinstance(found, list) else ():
            if isinstance(r, dict) and r.get("sku"):
                out.append((requirement, entry.get("candidate_set_fingerprint"), str(r["sku"]), r.get("status"), json.dumps(r, ensure_ascii=False, sort_keys=True)))
    return out


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """requirement_id, fingerprint (of the pool that was reviewed), sku, status, record of every
    review in files of reviews; missing and broken files and records of other shapes give no row."""
    return _parsed(_documents(spark, path), _reviewed, "requirement_id string, fingerprint string, sku string, status string, record string")


def _annotated(data: dict) -> list[tuple]:
    out = []
    for kind in ("sku_mapping", "system_category_mapping"):
        found = data.get(kind)
        for key, e in found.items() if isinstance(found, dict) else ():
            if isinstance(e, dict):
                confidence = e.get("confidence")
                out.append((kind, key, e.get("requirement_id"), float(confidence) if isinstance(confidence, (int, float)) else None, e.get("note")))
    return out


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Kind (sku_mapping, system_category_mapping), key, requirement_id, confidence, note of every
    annotation; missing and broken files give no row."""
    return _parsed(_documents(spark, path), _annotated, "kind string, key string, requirement_id string, confidence double, note string")


def allowed_domains(spark: SparkSession, path: str) -> DataFrame:
    """Domain of every line that isn't blank: lower case, no scheme, no slashes at the end."""
    return suppliers(spark, path).select(F.lower(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/+$", "")).alias("domain"))


def cached_responses(wanted: DataFrame, cache: DataFrame, url: str = "url") -> DataFrame:
    """The columns of ``wanted`` and body: what ``cache`` (key: SHA-256 of the address, body: a
    JSON object as text) holds for each address; what isn't there or isn't JSON is null, a miss. Of
    several sound bodies of a key the greatest holds."""
    sound = cache.filter(F.try_parse_json("body").isNotNull()).groupBy("key").agg(F.max("body").alias("body"))
    return wanted.withColumn("key", F.sha2(F.col(url), 256)).join(sound, "key", "left").drop("key")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Path and SHA-256 of the bytes of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
