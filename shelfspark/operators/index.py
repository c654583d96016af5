"""An index of image vectors, built by hash from a cache that mends itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.vectors import cached
from shelfspark.session import cut_lineage

Encoder = Callable[[list[str]], np.ndarray]


def image_rows(products: DataFrame, key: str, images: Column, primary: Column, most: int = 1) -> DataFrame:
    """Key, position, image: a product's first ``most`` images (three at most), its primary image
    if it has no other. Null images are left out, products without any give no row."""
    some = F.slice(F.filter(F.coalesce(images, F.array().cast("array<string>")), lambda x: x.isNotNull()), 1, max(1, min(most, 3)))
    one = F.when(F.size(some) > 0, some).when(primary.isNotNull(), F.array(primary)).otherwise(F.array().cast("array<string>"))
    return products.select(key, F.posexplode(one).alias("position", "image")).withColumn("position", (F.col("position") + 1).cast("long"))


def encoded(pending: DataFrame, encode: Encoder, dim: int) -> DataFrame:
    """``pending`` (with a column image) and the unit vector of each row, in batches of Arrow."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                v = np.asarray(encode(pdf["image"].tolist()), float).reshape(len(pdf), dim)
                yield pdf.assign(vector=list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pending.schema)
    return pending.mapInPandas(run, f"{fields}, vector array<double>")


def build(images: DataFrame, cache: DataFrame, encode: Encoder, model: str, version: str, dim: int, path: str) -> DataFrame:
    """Writes the index of ``images`` (with a column image) under ``path`` and returns it: the
    images' columns, image_hash, vector, from_cache.

    Every distinct image is looked up in ``cache`` (model, version, hash, vector) once; what isn't
    there, is of another version or is broken (not ``dim`` finite numbers) is encoded, once for all
    its rows, and added to the cache written beside the index, so the next build finds it.
    """
    rows = images.withColumn("image_hash", F.sha2("image", 256))
    wanted = rows.groupBy(F.col("image_hash").alias("hash")).agg(F.min("image").alias("image")).select(F.lit(model).alias("model"), F.lit(version).alias("version"), "hash", "image")
    held = cached(wanted, cache, dim)
    both = wanted.join(held.select("hash", "vector"), "hash")
    new = cut_lineage(encoded(both.filter("vector is null").drop("vector"), encode, dim))
    known = both.filter("vector is not null").select("hash", F.col("vector").cast("array<double>").alias("vector"), F.lit(True).alias("from_cache"))
    vectors = known.unionByName(new.select("hash", "vector", F.lit(False).alias("from_cache")))
    index = rows.join(vectors.withColumnRenamed("hash", "image_hash"), "image_hash")
    index.write.mode("overwrite").parquet(f"{path}/index")
    sound = vectors.select(F.lit(model).alias("model"), F.lit(version).alias("version"), "hash", "vector")
    sound.write.mode("overwrite").parquet(f"{path}/cache")
    return load(images.sparkSession, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The index written under ``path``."""
    return spark.read.parquet(f"{path}/index")


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache written with it."""
    return spark.read.parquet(f"{path}/cache")
