"""Exact vector search in blocks.

The queries are a stated set that is sent to every task; each task multiplies its block of the
corpus with the queries' matrix in double precision and keeps its own best k per query, so only
k rows per query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.ranking import top_k

#: Most queries that are sent to every task at once; more are searched in several passes.
QUERY_BLOCK = 4096


def cosine(a, b):
    """Cosine of two array columns in double precision, norms floored at 1e-12."""
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.greatest(F.sqrt(F.aggregate(d(c), F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return dot / (norm(a) * norm(b))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest scores of every row, all equals of the k-th among them
    taken in the order of ``keys``."""
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        who, place = np.nonzero(scores >= least)
    else:
        who, place = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((keys[place], -scores[who, place], who))
    who, place = who[order], place[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    return who[rank < k], place[rank < k]


def search(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, query_key: str | None = None) -> DataFrame:
    """query_id, key, score, rank_no: the k nearest rows of ``corpus`` for every query by cosine;
    ties go to the smaller key. Null vectors on either side find nothing."""
    query_key = query_key or key
    kind, qkind = corpus.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    asked = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("v")).filter("v is not null")
    total = asked.count()
    found = None
    for block in range(max(1, -(-total // QUERY_BLOCK))):
        part = asked.filter(F.pmod(F.xxhash64("q"), F.lit(max(1, -(-total // QUERY_BLOCK)))) == block).toPandas()
        matrix = _unit(np.array(part["v"].tolist(), dtype=np.float64)) if len(part) else np.zeros((0, 1))
        spread = corpus.sparkSession.sparkContext.broadcast((part["q"].tolist(), matrix))

        def run(frames: Iterator[pd.DataFrame], spread=spread) -> Iterator[pd.DataFrame]:
            ids, m = spread.value
            if not ids:
                return
            for pdf in frames:
                if pdf.empty:
                    continue
                scores = np.round(m @ _unit(np.array(pdf["v"].tolist(), dtype=np.float64)).T, 12)
                who, place = _best(scores, pdf["k"].to_numpy(), k)
                yield pd.DataFrame({"query_id": pd.Series(ids)[who].to_numpy(), "k": pdf["k"].to_numpy()[place], "score": scores[who, place]})

        hits = corpus.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter("v is not null").mapInPandas(run, f"query_id {qkind}, k {kind}, score double")
        found = hits if found is None else found.unionByName(hits)
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col("k").asc()], k).withColumnRenamed("k", key)


def per_product(image_scores: DataFrame, query: str, product: str, score: str, image: str) -> DataFrame:
    """A product's best image per query, the first image of equals."""
    best = F.max_by(F.struct(image, score), F.struct(F.col(score), -F.col(image)))
    return image_scores.groupBy(query, product).agg(best.alias("_b")).select(query, product, F.col(f"_b.{score}").alias(score), F.col(f"_b.{image}").alias("best_image"))


def grouped_search(corpus: DataFrame, queries: DataFrame, group: str, vector: str, product: str, image: str, k: int, mode: str = "max", text: DataFrame | None = None, weight: float = 0.15) -> DataFrame:
    """Group, product, score, best_image, rank_no.

    An image's score is the maximum (or mean) of its similarity to the group's query vectors, with
    ``text`` (one vector per group) mixed in as (1 - weight) * image + weight * text; a product
    takes its best image, the smaller id of equals. A product among the best k of all is among
    the best k of the block that holds its best image, so tasks send k products per group. Query
    groups beyond ``QUERY_BLOCK`` vectors are asked in several passes. Null vectors find nothing; no
    query or an empty corpus gives no row.
    """
    gk, pk, ik = queries.schema[group].dataType.simpleString(), corpus.schema[product].dataType.simpleString(), corpus.schema[image].dataType.simpleString()
    asked = queries.select(F.col(group).alias("g"), F.col(vector).alias("v")).filter("v is not null")
    passes = max(1, -(-asked.count() // QUERY_BLOCK))
    images = corpus.select(F.col(product).alias("p"), F.col(image).alias("i"), F.col(vector).alias("v")).filter("v is not null")
    of_block = lambda df, n: df.filter(F.pmod(F.xxhash64("g"), F.lit(passes)) == n)
    hits = None
    for n in range(passes):
        part = of_block(asked, n).toPandas().sort_values("g", kind="stable")
        groups, starts = np.unique(part["g"].to_numpy(), return_index=True)
        words = None
        if text is not None:
            said = {r["g"]: r["v"] for r in of_block(text.select(F.col(group).alias("g"), F.col(vector).alias("v")), n).collect()}
            words = _unit(np.array([said[g] for g in groups.tolist()], dtype=np.float64)) if len(groups) else None
        matrix = _unit(np.array(part["v"].tolist(), dtype=np.float64)) if len(part) else np.zeros((0, 1))
        spread = corpus.sparkSession.sparkContext.broadcast((groups.tolist(), starts, matrix, words))

        def run(frames: Iterator[pd.DataFrame], spread=spread) -> Iterator[pd.DataFrame]:
            ids, at, m, w = spread.value
            if not ids:
                return
            for pdf in frames:
                if pdf.empty:
                    continue
                pdf = pdf.sort_values(["p", "i"], kind="stable")
                vectors = _unit(np.array(pdf["v"].tolist(), dtype=np.float64)).T
                sims = m @ vectors
                scores = np.maximum.reduceat(sims, at, axis=0) if mode == "max" else np.add.reduceat(sims, at, axis=0) / np.diff(np.r_[at, len(sims)])[:, None]
                if w is not None:
                    scores = (1 - weight) * scores + weight * (w @ vectors)
                scores = np.round(scores, 12)
                # a product's best image, the first of equals; then the best products
                products, first = np.unique(pdf["p"].to_numpy(), return_index=True)
                top = np.maximum.reduceat(scores, first, axis=1)
                who, place = _best(top, products, k)
                last = np.r_[first[1:], len(pdf)]
                image = [first[j] + int(np.argmax(scores[g, first[j] : last[j]])) for g, j in zip(who, place)]
                yield pd.DataFrame({"g": pd.Series(ids)[who].to_numpy(), "p": products[place], "score": top[who, place], "i": pdf["i"].to_numpy()[image]})

        found = images.mapInPandas(run, f"g {gk}, p {pk}, score double, i {ik}")
        hits = found if hits is None else hits.unionByName(found)
    best = hits.groupBy("g", "p").agg(F.max("score").alias("score"), F.min_by("i", F.struct(-F.col("score"), "i")).alias("best_image"))
    return top_k(best, ["g"], [F.col("score").desc(), F.col("p").asc()], k).select(F.col("g").alias(group), F.col("p").alias(product), "score", "best_image", "rank_no")


def cached(wanted: DataFrame, cache: DataFrame, dim: int) -> DataFrame:
    """Model, version, hash, vector of every key of ``wanted``, each once: the cache's vector
    of just that model, version and hash if it is sound (``dim`` numbers, all finite), else null:
    it is to be encoded again. Of several sound ones the smallest holds."""
    keys = ["model", "version", "hash"]
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = cache.filter((F.size("vector") == dim) & finite).groupBy(*keys).agg(F.min("vector").alias("vector"))
    return wanted.select(*keys).distinct().join(sound, keys, "left")
