"""Reports from small results (K6, K7, K9, K12): nested JSON by Spark, text on the driver."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.ranking import top_k

#: Most rows of a report that is rendered on the driver.
MOST_ROWS = 10_000


def nested(rows: DataFrame, group: str, order: list[Column], fields: list[str], k: int = 5) -> DataFrame:
    """K6: one document per group with its first k rows in order."""
    best = top_k(rows, [group], order, k)
    return best.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", *fields))), lambda x: x).alias("items"))


def write_json(documents: DataFrame, path: str, partition: str | None = None) -> None:
    """JSON lines, a folder per value of ``partition`` if given."""
    writer = documents.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).json(path)


def _rows(rows: DataFrame) -> list:
    got = rows.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError("too many rows for a rendered report")
    return got


def markdown(rows: DataFrame, title: str, empty: str = "No rows.") -> str:
    """K9: a table; bars in values are escaped."""
    got = _rows(rows)
    if not got:
        return f"# {title}\n\n{empty}\n"
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "-|" * len(rows.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join(cell(v) for v in r) + " |" for r in got) + "\n"


def html(rows: DataFrame, title: str, empty: str = "No rows.") -> str:
    """K6: the same as an escaped page."""
    got = _rows(rows)
    cells = lambda r, tag: "<tr>" + "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in r) + "</tr>"
    body = f"<p>{escape(empty)}</p>" if not got else "<table>" + cells(rows.columns, "th") + "".join(cells(r, "td") for r in got) + "</table>"
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>{body}"
