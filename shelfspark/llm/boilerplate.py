"""Page boilerplate mixed with main content.

The texts of a host are joined to one stream of tokens, and a suffix array over it tells which runs
of tokens stand on several distinct pages. What repeats decides; no word of any language is known
here:

- A line is covered when the run it begins with (``LEAD`` tokens, or the whole of a shorter line)
  begins lines of ``PAGES`` pages or more. Lines that nothing covers are unique and stay.
- A covered line is free when its run stands in the middle of other lines, too, at the beginning of
  a sentence: sentences about products are put together in ever new ways, a page's own lines are
  not. Free lines stay. A line that ends as a sentence does is free by one such line; it goes only
  if it stands as a whole on ``TEMPLATE_PAGES`` pages.
- A line "name: value" stays if the name is a property's: a host gives it several short values, and
  these recur over the corpus.

``other_lines`` is for fields that hold one statement among remains of the page: of its lines, it is
the one that stands as a whole text by itself on other pages of the host, else one that repeats on few.

Hosts are cut into shards, so no task holds more than ``SHARD_CHARS`` and one page; of a host in
several shards all counts are summed over them by fingerprints of the runs before anything is
decided, so shards give what one block gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.session import blocks, cut_lineage

#: Text one task looks at together.
SHARD_CHARS = 8_000_000
#: Tokens of the run that covers a line; pages that make it a repeat; pages that make a sentence a template's.
LEAD, PAGES, TEMPLATE_PAGES = 3, 2, 5
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|\x00|[^\s\w]|_")
_PROPERTY = re.compile(r"\s*([^\W\d_]+(?: [^\W\d_]+){0,2})(?:\s*[:=—–]\s*|\s+-\s+)(\w[\w,.%-]*(?: \w[\w,.%-]*){0,2})\s*")
_STARTS, _ENDS, _CLOSES = ".!?…:", ".…", ")]\"»”"


class Suffixes:
    """Suffix array of integer tokens by prefix doubling; ``levels[k]`` holds the rank of every
    place by its first 2**k tokens. Only places whose ranks are still shared are sorted again."""

    def __init__(self, tokens: np.ndarray, depth: int | None = None) -> None:
        n = len(tokens)
        _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        rank = (np.cumsum(counts) - counts)[inverse] if n else np.zeros(0, int)
        self.order = np.argsort(rank, kind="stable")
        self.levels = [rank.astype(np.int32)]
        k = 1
        while k < min(n, depth or n):
            rank = self.levels[-1]
            again = rank[self.order[1:]] == rank[self.order[:-1]]
            slots = np.flatnonzero(np.r_[False, again] | np.r_[again, False])
            if not len(slots):
                break
            at = self.order[slots]
            after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
            key = rank[at].astype(np.int64) * (n + 1) + after
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            self.order[slots] = at
            first = np.r_[True, key[1:] != key[:-1]]
            new = rank.copy()
            new[at] = np.maximum.accumulate(np.where(first, slots, 0))
            self.levels.append(new)
            k *= 2

    def same(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A number for every run (start, length > 0): equal runs have equal numbers. A run is
        told by the ranks of the two powers of two that cover it."""
        level = np.minimum(np.frexp(lengths.astype(float))[1] - 1, len(self.levels) - 1)
        head, tail = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for k in np.unique(level):
            of = level == k
            head[of] = self.levels[k][starts[of]]
            tail[of] = self.levels[k][starts[of] + lengths[of] - (1 << int(k))]
        pair = pd.factorize(head * (len(self.order) + 1) + tail)[0].astype(np.int64)
        return pd.factorize(pair * (int(lengths.max(initial=0)) + 1) + lengths)[0]


class Lines(NamedTuple):
    """The lines of the pages of a stream, in order, and the beginnings of sentences within lines."""

    page: np.ndarray
    no: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sentence: np.ndarray  # does it end as a sentence does
    middle: np.ndarray  # places
    middle_line: np.ndarray
    tokens: np.ndarray
    words: np.ndarray


def read(pages: list[str]) -> Lines:
    """Tokens are folded, all numbers count as one."""
    found = _TOKEN.findall("".join("\x00\n" + t.replace("\x00", " ") + "\n" for t in pages))
    codes, spelt = pd.factorize(np.array(found, object)) if found else (np.zeros(0, int), np.zeros(0, object))
    folded, words = pd.factorize(np.array(["#" if w[0].isnumeric() else w.casefold() for w in spelt], object)) if len(spelt) else (codes, spelt)
    tokens = folded[codes].astype(np.int64) if len(spelt) else np.zeros(0, np.int64)
    code = {w: i for i, w in enumerate(words)}
    is_in = lambda marks: np.isin(tokens, [code[m] for m in marks if m in code])
    page = np.cumsum(tokens == code.get("\x00", -1)) - 1
    breaks = np.flatnonzero(tokens == code.get("\n", -1))
    inner = np.flatnonzero(page[breaks[1:]] == page[breaks[:-1]])
    start, length = breaks[inner] + 1, breaks[inner + 1] - breaks[inner] - 1
    of_page = page[start - 1] if len(start) else np.zeros(0, int)
    first = np.r_[True, of_page[1:] != of_page[:-1]] if len(of_page) else np.zeros(0, bool)
    no = np.arange(len(start)) - np.maximum.accumulate(np.where(first, np.arange(len(start)), 0)) + 1
    closes, ends, starts = is_in(_CLOSES), is_in(_ENDS), is_in(_STARTS)
    last = start + length - 1
    for _ in range(3):
        last = np.where((last >= start) & closes[last], last - 1, last)
    sentence = (last >= start) & ends[np.maximum(last, 0)] & (length > LEAD)
    middle = np.flatnonzero(starts[:-1] & (tokens[1:] != code.get("\n", -1))) + 1
    tokens[tokens == code.get("\x00", -1)] = -1 - np.arange(len(pages))  # no run crosses pages
    return Lines(of_page, no, start, length, sentence, middle, np.searchsorted(start, middle, "right") - 1, tokens, words)


def _distinct(group: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For every group (0 to n - 1) how many distinct values of ``of`` it holds."""
    top = int(of.max(initial=0)) + 1
    return np.bincount(np.unique(group * top + of) // top, minlength=n)


class Counts(NamedTuple):
    """What repeats, for every line: pages that begin a line with its run, pages on which it stands
    as a whole, texts that are nothing but it, distinct lines in whose middle its run stands."""

    lead: np.ndarray
    whole: np.ndarray
    alone: np.ndarray
    free: np.ndarray


def count(x: Lines) -> Counts:
    n = len(x.start)
    if not n:
        return Counts(*[np.zeros(0, np.int64)] * 4)
    sa = Suffixes(x.tokens, int(x.length.max()) + 2)
    whole = sa.same(x.start - 1, x.length + 2)
    lead = sa.same(x.start - 1, _run(x, x.start, np.arange(n)) + 1)
    loose = sa.same(np.r_[x.start, x.middle], np.r_[_run(x, x.start, np.arange(n)), _run(x, x.middle, x.middle_line)])
    single = np.bincount(x.page)[x.page] == 1
    return Counts(
        _distinct(lead, x.page, lead.max() + 1)[lead], _distinct(whole, x.page, whole.max() + 1)[whole],
        np.bincount(whole, weights=single, minlength=whole.max() + 1).astype(np.int64)[whole], _distinct(loose[n:], whole[x.middle_line], loose.max() + 1)[loose[:n]],
    )


def _run(x: Lines, at: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Length of the run that begins at a place of a line; a short one takes the line's end in."""
    return np.minimum(LEAD, x.start[line] + x.length[line] - at + 1)


def _prints(x: Lines, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints of runs that hold in every shard: sums of the tokens' hashes times powers."""
    hashes = pd.util.hash_array(x.words.astype(object))[np.maximum(x.tokens, 0)]
    power = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    out = np.zeros(len(starts), np.uint64)
    for lo in range(0, len(starts), 50_000):
        s, m = starts[lo : lo + 50_000], lengths[lo : lo + 50_000]
        ends = np.cumsum(m)
        places = np.arange(ends[-1]) - np.repeat(ends - m, m)
        out[lo : lo + 50_000] = np.add.reduceat(hashes[np.repeat(s, m) + places] * power[places], ends - m) * np.uint64(31) + m.astype(np.uint64)
    return out.view(np.int64)


_FIELDS = {"k": None, "h": "string", "s": "int", "page": "bigint", "line_no": "bigint", "line": "string", "sentence": "boolean", "blank": "boolean", "several": "boolean", "lead": "bigint", "whole": "bigint", "alone": "bigint", "free": "bigint", "name": "string", "value": "string", "lead_fp": "bigint", "whole_fp": "bigint"}
_SUMS = {"kind": "int", "fp": "bigint", "pages": "bigint", "low": "bigint", "high": "bigint"}
#: Kinds of the counts that are summed over shards.
_LEADS, _WHOLES, _ALONE, _FREE = range(4)


def _shard(keep: Callable[[Lines, Counts], np.ndarray], text_too: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The lines of a shard with what repeats, those that ``keep`` names; of a host of several
    shards all, and the counts to be summed up."""

    def run(pages: pd.DataFrame) -> pd.DataFrame:
        x = read(pages["t"].tolist())
        c = count(x)
        parts = int(pages["shards"].iloc[0])
        lines = [line for t in pages["t"] for line in t.replace("\x00", " ").split("\n")]
        shape = [m if (m := _PROPERTY.fullmatch(line)) and len(line) < 200 else None for line in lines]
        out = {
            "k": pages["k"].to_numpy()[x.page], "h": pages["h"].iloc[0], "s": pages["s"].iloc[0], "page": x.page, "line_no": x.no, "line": lines if text_too else None, "sentence": x.sentence, "blank": x.length == 0, "several": several(x),
            "lead": c.lead, "whole": c.whole, "alone": c.alone, "free": c.free, "name": [m and m[1].casefold() for m in shape], "value": [m and m[2].casefold() for m in shape], "lead_fp": None, "whole_fp": None,
        }
        sums = pd.DataFrame({f: pd.Series(dtype="object") for f in _SUMS})
        if parts > 1:
            n = len(x.start)
            own = np.arange(n)
            whole_fp, lead_fp = _prints(x, x.start, x.length + 1), _prints(x, x.start, _run(x, x.start, own))
            middle_fp = _prints(x, x.middle, _run(x, x.middle, x.middle_line)) if len(x.middle) else np.zeros(0, np.int64)
            out |= {"lead_fp": lead_fp, "whole_fp": whole_fp}
            sums = pd.concat([
                pd.DataFrame({"kind": _LEADS, "fp": lead_fp, "pages": c.lead}).drop_duplicates(), pd.DataFrame({"kind": _WHOLES, "fp": whole_fp, "pages": c.whole}).drop_duplicates(), pd.DataFrame({"kind": _ALONE, "fp": whole_fp, "pages": c.alone}).drop_duplicates(),
                pd.DataFrame({"kind": _FREE, "fp": middle_fp, "in": whole_fp[x.middle_line]}).groupby(["kind", "fp"], as_index=False).agg(low=("in", "min"), high=("in", "max")),
            ])
        frame = pd.DataFrame(out)
        if parts == 1:
            frame = frame[keep(x, c) | frame["name"].notna().to_numpy()]
        sums = sums.assign(h=pages["h"].iloc[0], s=pages["s"].iloc[0])
        return pd.concat([frame, sums]).reindex(columns=[*_FIELDS, *_SUMS]) if len(sums) else frame.reindex(columns=[*_FIELDS, *_SUMS])

    return run


def evidence(pages: DataFrame, key: str, host: str, text: str, keep: Callable[[Lines, Counts], np.ndarray], text_too: bool = False) -> DataFrame:
    """One row per line (those ``keep`` names) with what repeats of it on its host."""
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("k"), F.coalesce(F.col(host), F.lit("")).alias("h"), F.col(text).alias("t")).filter("t is not null")
    large = rows.groupBy("h").agg(F.ceil(F.sum(F.length("t")) / SHARD_CHARS).cast("int").alias("shards")).filter("shards > 1")
    shards = F.coalesce("shards", F.lit(1))
    rows = rows.join(large, "h", "left").select("k", "h", "t", shards.alias("shards"), F.pmod(F.xxhash64("k", "t"), shards).cast("int").alias("s"))
    types = _FIELDS | {"k": kind}
    schema = ", ".join(f"{f} {t}" for f, t in (types | _SUMS).items())
    found = cut_lineage(rows.repartition(blocks(pages.sparkSession), "h", "s").groupBy("h", "s").applyInPandas(_shard(keep, text_too), schema))
    lines = found.filter("kind is null").select(*_FIELDS)
    # hosts in several shards: sums over the shards, brought back once for every shard
    sums = found.filter("kind is not null").select("h", "s", *_SUMS)
    if sums.isEmpty():
        return lines
    free = F.when(F.min("low") < F.max("high"), 2).otherwise(1)  # two distinct lines are enough to know
    total = sums.groupBy("h", "kind", "fp").agg(F.when(F.col("kind") == _FREE, free).otherwise(F.sum("pages")).cast("bigint").alias("n"))
    asked = sums.filter(F.col("kind") != _FREE).select("h", "s", "kind", "fp")
    asked = asked.unionByName(asked.filter(F.col("kind") == _LEADS).withColumn("kind", F.lit(_FREE)))
    back = asked.join(total, ["h", "kind", "fp"])
    parted = lines.filter("lead_fp is not null")
    for name, fp, of in (("lead", "lead_fp", _LEADS), ("whole", "whole_fp", _WHOLES), ("alone", "whole_fp", _ALONE), ("free", "lead_fp", _FREE)):
        got = back.filter(F.col("kind") == of).select("h", "s", "fp", "n")
        got = got.withColumnsRenamed({"fp": fp, "n": f"_{name}"})
        parted = parted.join(got, ["h", "s", fp], "left").withColumn(name, F.coalesce(f"_{name}", F.lit(0))).drop(f"_{name}")
    return lines.filter("lead_fp is null").unionByName(parted.select(*_FIELDS))


def several(x: Lines) -> np.ndarray:
    """Which lines are of texts of two lines or more."""
    return np.bincount(x.page)[x.page] > 1 if len(x.page) else np.zeros(0, bool)


def _template(x: Lines, c: Counts) -> np.ndarray:
    covered = (c.lead >= PAGES) & (c.free < np.where(x.sentence, 1, 2)) & (~x.sentence | (c.whole >= TEMPLATE_PAGES))
    return several(x) & ((x.length == 0) | covered)


def property_names(lines: DataFrame) -> DataFrame:
    """name: of lines "name: value" those of properties: on one host at least they have two values,
    and of all lines with the name at least half have a value that recurs, as two values do."""
    each = lines.filter("name is not null").groupBy("name", "h", "value").agg(F.count("*").alias("n"))
    hosts = each.groupBy("name", "h").agg(F.count("*").alias("values")).groupBy("name").agg(F.max("values").alias("values")).filter("values > 1")
    values = each.groupBy("name", "value").agg(F.sum("n").alias("n"))
    recur = values.groupBy("name").agg(F.count_if(F.col("n") > 1).alias("recurring"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("in_them"), F.sum("n").alias("all"))
    return recur.filter("recurring > 1 and 2 * in_them >= all").join(hosts, "name", "left_semi").select("name")


def boilerplate_lines(pages: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """key, line_no (from 1) of every line that isn't main content, of texts of two lines or more.

    Null texts give no row, empty and one-line texts are read but give no row; blank lines count as
    boilerplate; a null host is a host of its own; texts are read whole, to the last token; repeated
    rows count as pages of their own and repeat; other columns are ignored.
    """
    lines = evidence(pages, key, host, text, _template)
    least: Column = F.when(F.col("sentence"), 1).otherwise(2)
    covered = (F.col("lead") >= PAGES) & (F.col("free") < least) & (~F.col("sentence") | (F.col("whole") >= TEMPLATE_PAGES))
    out = lines.filter("several").filter(F.col("blank") | covered)
    named = out.filter("name is not null").join(property_names(lines), "name", "left_anti")
    return out.filter("name is null").select("k", "line_no").unionByName(named.select("k", "line_no")).withColumnRenamed("k", key)


def other_lines(pages: DataFrame, key: str, host: str, text: str, states: Callable[[], Callable[[str], float]]) -> DataFrame:
    """key, line_no (from 1) of the lines of a text of two lines or more that aren't its one
    statement.

    Of a text's lines the statement is the one with the greatest share of texts that are nothing
    but it among all of the host's texts that hold it; of equals one that stands on fewer than
    ``TEMPLATE_PAGES`` pages. Where repeats tell no difference, ``states`` (makes a function, in the task,
    that says how surely a line states something) decides, then the order; if that says nothing
    either, the text states nothing and all its lines come out. Blank lines are never the statement.
    Null and one-line texts give no row; repeated rows count as pages of their own and repeat.
    """
    lines = evidence(pages, key, host, text, lambda x, c: several(x), text_too=True).filter("several")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sure = states()
        for pdf in frames:
            yield pdf[["k", "h", "s", "page", "line_no"]].assign(tied=-1.0 * (pdf["whole"] >= TEMPLATE_PAGES), share=pdf["alone"] / pdf["whole"].clip(lower=1), sure=[sure(x) for x in pdf["line"]])

    kind = pages.schema[key].dataType.simpleString()
    rated = lines.filter("not blank").select("k", "h", "s", "page", "line_no", "line", "whole", "alone").mapInPandas(judge, f"k {kind}, h string, s int, page bigint, line_no bigint, tied double, share double, sure double")
    of_text = Window.partitionBy("h", "s", "page").orderBy(F.desc("share"), F.desc("tied"), F.desc("sure"), "line_no")
    second = F.lead(F.struct("share", "tied")).over(of_text)
    best = rated.select("h", "s", "page", "line_no", F.row_number().over(of_text).alias("r"), (F.col("sure") <= 0).alias("silent"), second.eqNullSafe(F.struct("share", "tied")).alias("equal"))
    best = best.filter("r = 1 and not (silent and equal)").select("h", "s", "page", "line_no")
    return lines.join(best, ["h", "s", "page", "line_no"], "left_anti").select("k", "line_no").withColumnRenamed("k", key)
