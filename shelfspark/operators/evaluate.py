"""Measures of rankings and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 5, 10, 20, 50, 100)


def metric_summary(ranks: DataFrame, rank: str, by: list[str]) -> DataFrame:
    """Targets, found, recall at the cuts, mean reciprocal rank (a missing target counts 0)
    and the median rank of those found. A null rank is a target that wasn't found."""
    r = F.col(rank)
    aggs = [F.count("*").alias("targets"), F.count(r).alias("found")]
    aggs += [F.round(F.count_if(r <= k) / F.count("*"), 6).alias(f"recall_at_{k}") for k in CUTS]
    aggs += [F.round(F.sum(F.coalesce(F.lit(1.0) / r, F.lit(0.0))) / F.count("*"), 6).alias("mrr"), F.median(r).cast("double").alias("median_rank")]
    return (ranks.groupBy(*by) if by else ranks).agg(*aggs)


def stage_recall(items: DataFrame, by: list[str], stages: dict[str, Column]) -> DataFrame:
    """How many items reach each stage, and the share; null where there are none."""
    aggs = [F.count("*").alias("targets")]
    for name, reached in stages.items():
        aggs += [F.count_if(reached).alias(name), F.round(F.try_divide(F.count_if(reached), F.count("*")), 6).alias(f"{name}_recall")]
    return (items.groupBy(*by) if by else items).agg(*aggs)


def diagnosis(checks: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first check that fails names the loss."""
    case = None
    for name, failed in checks:
        case = F.when(failed, name) if case is None else case.when(failed, name)
    return case.otherwise(otherwise)
