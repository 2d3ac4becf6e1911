"""Top N rows of every group, with an exact and stable tie rule.

Method: one global range-partitioned sort on group, order and identifier; a group of any size is spread over as many
partitions as it needs. Each partition counts its rows per group as it streams by; the counts of earlier partitions
are prefix-summed per group, which turns places within a partition into exact positions in the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankspark.operators.positions import exact_positions


def best_scores(runs: DataFrame, group: list[str], item: str, score: str) -> DataFrame:
    """One row per group and item with its highest score. Null and NaN scores and null items do not count; infinite
    scores do; 0.0 and -0.0 are one score."""
    s = F.col(score).cast("double")
    return runs.where(s.isNotNull() & ~F.isnan(s) & F.col(item).isNotNull()).groupBy(*group, item).agg((F.max(s) + F.lit(0.0)).alias(score))


def top_n(runs: DataFrame, n: int = 10, group: tuple[str, ...] = ("run_id", "query_number"), item: str = "docno", score: str = "score") -> DataFrame:
    """``group, item, score, pos``: per group the first ``n`` items by score descending, then item descending.

    An item counts once per group, with its highest score; the stored rank and extra columns are ignored. Repeated
    rows have no effect; an empty table gives an empty result.
    """
    best = best_scores(runs, list(group), item, score)
    return exact_positions(best, list(group), [F.col(score).desc(), F.col(item).desc()], n)
