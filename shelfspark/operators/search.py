"""Full-text search with BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import WORD
from shelfspark.operators.ranking import top_k

K1, B = 1.2, 0.75
#: Most distinct words that are sent to every task; beyond that words are joined.
MOST_WORDS = 100_000


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def bm25(corpus: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int, first_if_empty: bool = False) -> DataFrame:
    """query, key, score, rank_no: the k best rows that hold all words of the query.

    Rows keep only words that are asked before anything is shuffled, so what moves follows the
    hits and not the corpus. Ties go to the smaller key; a query without words finds nothing or, with ``first_if_empty``,
    the first k rows by key, without a score.
    """
    asked = queries.select(F.col(query_key).alias("q"), F.explode(F.array_distinct(words(F.col(query_text)))).alias("w"))
    vocabulary = [r["w"] for r in asked.select("w").distinct().limit(MOST_WORDS + 1).collect()]
    docs = corpus.select(F.col(key).alias("k"), words(F.col(text)).alias("ws"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("ws")).alias("mean"))
    if len(vocabulary) <= MOST_WORDS:
        held = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
        hits = docs.select("k", F.size("ws").alias("len"), F.explode(F.filter("ws", lambda w: F.array_contains(held, w))).alias("w"))
    else:
        hits = docs.select("k", F.size("ws").alias("len"), F.explode("ws").alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    tf = hits.groupBy("k", "len", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    scored = tf.join(df, "w").join(asked, "w").join(stats, how="cross")  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    needed = asked.groupBy("q").agg(F.count("*").alias("need"))
    total = scored.groupBy("q", "k").agg(F.round(F.sum(part), 9).alias("score"), F.count("*").alias("have"))
    total = total.join(needed, "q").filter("have = need").select("q", "k", "score")
    best = top_k(total, ["q"], [F.col("score").desc(), F.col("k").asc()], k)
    if first_if_empty:
        first = corpus.select(F.col(key).alias("k")).orderBy("k").limit(k).agg(F.array_sort(F.collect_list("k")).alias("ks"))  # one row of k keys
        silent = queries.select(F.col(query_key).alias("q"), words(F.col(query_text)).alias("w")).filter(F.size("w") == 0)
        firsts = silent.join(first, how="cross").select("q", F.posexplode("ks").alias("n", "k")).select("q", "k", F.lit(None).cast("double").alias("score"), (F.col("n") + 1).alias("rank_no"))
        best = best.unionByName(firsts)
    return best.withColumnsRenamed({"q": query_key, "k": key})
