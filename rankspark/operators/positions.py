"""Exact positions and running sums within groups of any size.

A group is never sorted in one task: rows are range-partitioned by group and order, each partition works on its own
stretch, and what the partitions before it hold of the same group is prefix-summed and added. The table of these
offsets has at most one row per partition, since a group only goes on from an earlier partition at its lower border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rankspark.plans.stage import materialise

SPLIT = 1_000_000  # rows of a group that one task sorts; larger groups are split


def _marks(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Key columns as text that is never null, so that null keys form a group."""
    marks = [f"_k{i}" for i in range(len(keys))]
    return df.withColumns({m: F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")) for m, k in zip(marks, keys, strict=True)}), marks


def _local_positions(keys: list[str], bound: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        last, seen = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            for k in keys:
                a = pdf[k].to_numpy(object)
                new[1:] |= a[1:] != a[:-1]
            first = tuple(pdf[k].iloc[0] for k in keys)
            new[0] = True
            at = np.arange(len(pdf))
            start = np.maximum.accumulate(np.where(new, at, 0))
            pos = at - start + 1
            if first == last:
                pos[start == 0] += seen
            last, seen = tuple(pdf[k].iloc[-1] for k in keys), int(pos[-1])
            keep = pos <= pdf[bound].to_numpy()
            out = pdf[keep].copy()
            out["_pid"], out["_lpos"] = np.int32(pid), pos[keep].astype("int64")
            yield out

    return run


def exact_positions(df: DataFrame, keys: list[str], order: list[Column], n: int | Column | None = None, pos: str = "pos") -> DataFrame:
    """``df`` with its exact position (bigint, from 1) within the group of ``keys``, under ``order``.

    ``order`` must be total, else rows equal under it come in any order. Null keys form one group. With ``n`` (a
    number, or a column that is constant within a group) only positions up to it are kept; rows beyond it are let go
    in the partition that sorts them. Nothing is collected; what is broadcast is at most one row per partition.
    """
    bound = F.lit(2**62) if n is None else F.lit(n) if isinstance(n, int) else n
    marked, marks = _marks(df, keys)
    marked = marked.withColumn("_n", F.coalesce(bound.cast("bigint"), F.lit(0)))
    by = [F.col(m).asc() for m in marks] + order
    ranged = marked.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = T.StructType([*marked.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_lpos", T.LongType())])
    local = materialise(ranged.mapInPandas(_local_positions(marks, "_n"), schema))
    before = Window.partitionBy(*marks).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = local.groupBy(*marks, "_pid").agg(F.max("_lpos").alias("_c"))
    offsets = counts.withColumn("_off", F.sum("_c").over(before)).where("_off > 0").drop("_c")
    placed = local.join(F.broadcast(offsets), [*marks, "_pid"], "left").withColumn(pos, F.col("_lpos") + F.coalesce("_off", F.lit(0)))
    return placed.where(F.col(pos) <= F.col("_n")).drop(*marks, "_n", "_pid", "_lpos", "_off")


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], largest: int) -> DataFrame:
    """``df`` with the running sum of each of ``sums`` (not null) over its group's rows up to and including its own.

    ``largest``: rows of the largest group, as largest_group() counts them. Up to SPLIT one window per group does;
    beyond it groups are split by range as above, with the same result (sums of floating-point numbers may differ in
    their last digits, as the order of addition does). ``order`` must be total.
    """
    if largest <= SPLIT:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    marked, marks = _marks(df, keys)
    by = [F.col(m).asc() for m in marks] + order
    names = {name: f"_s{i}" for i, name in enumerate(sums)}
    ranged = materialise(marked.withColumns({names[k]: c for k, c in sums.items()}).repartitionByRange(*by).withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy(*marks).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*marks, "_pid").agg(*[F.sum(c).alias(c) for c in names.values()])
    offsets = totals.select(*marks, "_pid", *[F.sum(c).over(before).alias(f"{c}o") for c in names.values()], F.count(F.lit(1)).over(before).alias("_b")).where("_b > 0").drop("_b")
    here = Window.partitionBy(*marks, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({c: F.sum(c).over(here) for c in names.values()})
    j = local.join(F.broadcast(offsets), [*marks, "_pid"], "left")
    done = j.withColumns({name: F.col(c) + F.coalesce(F.col(f"{c}o"), F.lit(0)) for name, c in names.items()})
    return done.drop(*marks, "_pid", *names.values(), *[f"{c}o" for c in names.values()])
