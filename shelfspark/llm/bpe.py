"""Byte-level BPE encoding of a whole corpus with a public vocabulary.

A text is cut into pieces by the vocabulary's public pattern; within a piece the bytes form a
doubly linked list of symbols and a priority queue holds the merges possible now, keyed by
(rank, position). An entry is stale when one of its symbols has been merged since; it is skipped
when it comes up. A piece of k bytes costs O(k log k), so neither very long texts nor very long
words are a special case. Pieces repeat, so every worker keeps the ids of those it has seen.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers lie; a parameter of every operator, never copied into the package.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern of this vocabulary's pieces (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a worker remembers.
CACHE = 200_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Vocabulary strings with their ranks, which are the ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encodes and decodes with one vocabulary; null and empty texts are no ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.pieces = regex.compile(pattern)
        self.seen: dict[str, list[int]] = {}
        self.strings = {i: s for s, i in ranks.items()}

    def _merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        symbol = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            # stale: a symbol of this pair has been merged since the entry was made
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            joined = left + right
            symbol[i], symbol[j] = joined, b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(joined + symbol[k])) is not None:
                    heapq.heappush(queue, (r, i, joined, symbol[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(symbol[h] + joined)) is not None:
                heapq.heappush(queue, (r, h, symbol[h], joined))
        return [ranks[s] for s in symbol if s]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        seen = self.seen
        for piece in self.pieces.findall(text):
            ids = seen.get(piece)
            if ids is None:
                ids = self._merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


def _batches(spread, want: str):
    """Arrow batches of (key, text) to (key, ids), (key, number of ids) or (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spread.value)
        for batch in batches:
            lists = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
            if want == "count":
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], ["k", "n"])
                continue
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["k", "ids"])

    return run


def encode_texts(rows: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, ids array<int> of every row, without special tokens. Null and empty texts give an
    empty list; every row gives one row, repeated and null keys too; other columns are ignored.
    The vocabulary is read once by the driver and sent to the workers (under 2 MB)."""
    spread = rows.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(_batches(spread, "ids"), f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", key)


def count_tokens(rows: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, n_tokens bigint of every row; 0 for null and empty texts."""
    spread = rows.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(_batches(spread, "count"), f"k {kind}, n bigint")
    return out.withColumnsRenamed({"k": key, "n": "n_tokens"})


def decode_ids(rows: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, text: the vocabulary's strings concatenated; null lists give null."""
    spread = rows.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = {i: s for s, i in spread.value.items()}
        for batch in batches:
            texts = [None if x is None else b"".join(strings[i] for i in x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "t"])

    out = rows.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, t string")
    return out.withColumnsRenamed({"k": key, "t": "text"})
