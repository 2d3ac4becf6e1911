"""Merging the rankings of several engines.

Input is the multi-engine rank table ``qid, doc_id, ranks map<int,int>, label, seq``: null ranks are allowed, ``seq``
is the order of first appearance, which decides ties. A document in several rows of a query adds up. Results are
``qid, doc_id, score, rank``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankspark.operators.pairs import dealt
from rankspark.operators.positions import largest_group, running
from rankspark.plans.stage import maybe_broadcast, small_or_none

RRF_K = 100  # fixed value
UNROLLED = 64  # engines whose votes are written out one by one
FLOOR = 1e-4  # fixed value: what every slot of a rank histogram starts with


def long_ranks(rows: DataFrame) -> DataFrame:
    """``qid, doc_id, seq, label, engine, rank`` with null ranks kept; a document without ranks has one row of nulls."""
    return rows.select("qid", "doc_id", "seq", "label", F.explode_outer("ranks").alias("engine", "rank"))


def max_ranks(long: DataFrame) -> DataFrame:
    """The greatest rank each engine gives in any query. Engines are few; the join is broadcast if they are."""
    return maybe_broadcast(long.where("engine is not null").groupBy("engine").agg(F.max("rank").alias("max_rank")))


def _ranked(scores: DataFrame, largest: int, *more: Column) -> DataFrame:
    """Ranks by score; ``largest``: rows of the largest query."""
    placed = running(scores, ["qid"], [F.desc("score"), *more, F.asc("seq")], {"rank": F.lit(1)}, largest)
    return placed.select("qid", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


def _sum_scores(long: DataFrame, part: Column) -> DataFrame:
    """Sum of the parts per document; documents no engine ranked score 0."""
    s = long.groupBy("qid", "doc_id").agg(F.min("seq").alias("seq"), F.sum(F.when(F.col("rank").isNotNull(), part)).alias("score"))
    return s.withColumn("score", F.coalesce("score", F.lit(0.0)).cast("double"))


def rrf(rows: DataFrame, k: int = RRF_K, digits: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank) over the engines that rank a document. With ``digits`` scores are
    rounded before they are ranked, so that the order in which they were added up can't decide."""
    s = _sum_scores(long_ranks(rows), F.lit(1.0) / (F.lit(k) + F.col("rank")))
    return _ranked(s if digits is None else s.withColumn("score", F.round("score", digits)), largest_group(rows, ["qid"]))


def _borda_scores(rows: DataFrame) -> DataFrame:
    long = long_ranks(rows)
    return _sum_scores(long.join(max_ranks(long), "engine", "left"), F.col("max_rank") - F.col("rank") + 1)


def borda(rows: DataFrame) -> DataFrame:
    """Borda count: sum of (greatest rank of the engine - rank + 1)."""
    return _ranked(_borda_scores(rows), largest_group(rows, ["qid"]))


def engine_weights(rows: DataFrame, k: int = RRF_K) -> DataFrame:
    """``engine, weight``: how well an engine places what is labelled relevant; weights sum to 1."""
    s = long_ranks(rows).where("engine is not null").groupBy("engine").agg(F.coalesce(F.sum(F.col("label") / (F.lit(k) + F.col("rank"))), F.lit(0.0)).alias("s"))
    return s.select("engine", F.coalesce(F.try_divide(F.col("s"), F.sum("s").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)).alias("weight"))


def weighted_borda(rows: DataFrame, k: int = RRF_K) -> DataFrame:
    """Borda count with each engine's part weighted by engine_weights()."""
    long = long_ranks(rows)
    j = long.join(max_ranks(long), "engine", "left").join(maybe_broadcast(engine_weights(rows, k)), "engine", "left")
    return _ranked(_sum_scores(j, F.col("weight") * (F.col("max_rank") - F.col("rank") + 1)), largest_group(rows, ["qid"]))


def condorcet(rows: DataFrame) -> DataFrame:
    """Documents by how many others of their query they win against, then by Borda count.

    Of two rows the earlier one gets a vote from each engine that ranks it and the other not, or ranks it strictly
    better; else the later one does, unless neither is ranked. Equal votes are no win. All pairs of a query's rows are
    compared, those of one document too, and a row's wins count for its document; seq is unique within a query. A
    query's earlier rows are dealt into blocks, each of which meets all of its later rows.
    """
    # With few engines a row's ranks are columns by engine, else they stay a map.
    engines = small_or_none(rows.select(F.explode(F.map_keys("ranks")).alias("e")).distinct().orderBy("e"), UNROLLED)

    def vote(a: Column, b: Column) -> Column:
        return F.when(a.isNull() & b.isNull(), 0).when(b.isNull(), 1).when(a.isNull(), -1).when(a < b, 1).otherwise(-1)

    of = [F.col("ranks").alias("_m")] if engines is None else [F.col("ranks")[r.e].alias(f"_{i}") for i, r in enumerate(engines)]
    docs = rows.select("qid", "doc_id", "seq", *of)
    later = docs.toDF("qid", "d2", "s2", *[f"{c}l" for c in docs.columns[3:]])
    if engines is None:
        votes = F.aggregate(F.array_union(F.map_keys("_m"), F.map_keys("_ml")), F.lit(0), lambda acc, e: acc + vote(F.col("_m")[e], F.col("_ml")[e]))
    else:
        votes = sum((vote(F.col(c), F.col(f"{c}l")) for c in docs.columns[3:]), F.lit(0))
    left, right, on = dealt(docs, later, ["qid"], "seq")
    # The pairs are many times the rows, so the partitions mustn't be coalesced by the rows' size.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(n, *on).join(right.repartition(n, *on), on).where("seq < s2").select("qid", "doc_id", "d2", votes.alias("v")).where("v != 0")
    won = pairs.select("qid", F.when(F.col("v") > 0, F.col("doc_id")).otherwise(F.col("d2")).alias("doc_id")).groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("wins"))
    b = _borda_scores(rows).withColumnRenamed("score", "borda").join(won, ["qid", "doc_id"], "left")
    return _ranked(b.withColumn("score", F.coalesce("wins", F.lit(0)).cast("double")), largest_group(rows, ["qid"]), F.desc("borda"))


def _smooth(rows: DataFrame, reach: int, weight: Column, tops: DataFrame, name: str) -> DataFrame:
    """``engine, slot, name``: rank histograms with each rank spread over its neighbours by a Gaussian; a missing rank
    goes to the slot after the greatest."""
    j = rows.join(tops, "engine").withColumn("w", weight.cast("double"))
    near = F.sequence(F.greatest(F.lit(1), F.col("rank") - reach), F.least(F.col("rank") + reach, F.col("max_rank")))
    density = lambda x: F.exp(-(x * x) / 2.0) / math.sqrt(2 * math.pi)
    known = j.where("rank is not null").select("engine", "w", "rank", F.explode(near).alias("slot"))
    known = known.select("engine", "slot", (F.col("w") * density((F.col("slot") - F.col("rank")).cast("double"))).alias("x"))
    missing = j.where("rank is null").select("engine", (F.col("max_rank") + 1).alias("slot"), F.col("w").alias("x"))
    return known.unionByName(missing).groupBy("engine", "slot").agg((F.sum("x") + FLOOR).alias(name))


def bayes_fuse(rows: DataFrame, reach: int = 3, reach_irrelevant: int = 5) -> DataFrame:
    """Sum of log odds of relevance at each engine's rank, learnt from the labels of the same table.

    Relevant documents (label > 0) weigh as their label, the others 1; the engines of a query are those its first
    document names. Null ranks add nothing.
    """
    every = long_ranks(rows)
    long = every.where("engine is not null")
    tops = max_ranks(long)
    # null labels count as not relevant
    label = F.coalesce("label", F.lit(0))
    rel = _smooth(long.where(label > 0), reach, label, tops, "rel")
    irr = _smooth(long.where(label <= 0), reach_irrelevant, F.lit(1.0), tops, "irr")
    sums = rows.agg(F.sum(F.when(label > 0, label)).cast("double"), F.sum((label <= 0).cast("int")).cast("double")).first()
    n_rel, n_irr = (F.lit(x or 1.0) for x in sums)
    of = lambda name, n: F.log(F.coalesce(name, F.lit(FLOOR)) / n)
    odds = rel.join(irr, ["engine", "slot"], "full")
    odds = odds.select("engine", F.col("slot").alias("rank"), (of("rel", n_rel) - of("irr", n_irr)).alias("odds"))
    first = rows.groupBy("qid").agg(F.map_keys(F.min_by("ranks", "seq")).alias("engines"))
    used = every.join(first, "qid")
    counts = F.array_contains("engines", F.col("engine")) & F.col("rank").isNotNull()
    # Ranks no labelled document comes near have the floor in both histograms.
    bare = F.log(F.lit(FLOOR) / n_rel) - F.log(F.lit(FLOOR) / n_irr)
    j = used.join(odds, ["engine", "rank"], "left")
    return _ranked(_sum_scores(j, F.when(counts, F.coalesce("odds", bare))), largest_group(rows, ["qid"]))
