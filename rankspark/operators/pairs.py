"""Pairs within groups, where a group may hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLOCK = 1024  # rows of the left side that a task pairs with the group's right side


def dealt(left: DataFrame, right: DataFrame, keys: list[str], by: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on ``keys`` with a block number, and the columns to join on. A group's left rows are dealt to
    blocks by the hash of ``by``, its right rows go to every block of the group; groups of up to ``block`` rows have one.
    So no task pairs more than about a block with a group."""
    blocks = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    a = left.join(blocks, keys).withColumn("_blk", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")).drop("_blocks")
    b = right.join(blocks, keys).withColumn("_blk", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    return a, b, [*keys, "_blk"]
