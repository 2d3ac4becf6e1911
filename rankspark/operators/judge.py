"""Runs joined with judgments: the frame all measures are computed on.

Run and judgments of a document meet in one aggregation by query and document, which also finds those given twice. A
query's ranking is sorted once, and all running counts come from that sort; rankings of very many documents are split.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankspark.operators import positions
from rankspark.operators.positions import largest_group, running
from rankspark.plans.stage import materialise

# Relevance of a document that isn't in the pool, and of one in the pool that wasn't judged.
NOT_IN_POOL, UNJUDGED = -1, -2


@dataclass(frozen=True)
class EvalConfig:
    """measures: names, nicknames or ``name.params``; complete: average over all judged queries; judged_only: drop
    unjudged documents before ranks count; level: least relevance that counts as relevant; max_docs: documents per
    query looked at; collection_size: for utility; per_query/summary: which rows come out; only_query: one query."""

    measures: tuple[str, ...] = ("official",)
    complete: bool = False
    judged_only: bool = False
    level: int = 1
    max_docs: int = 2**31 - 1
    collection_size: int = 0
    per_query: bool = False
    summary: bool = True
    only_query: str | None = None
    keys: tuple[str, ...] = field(default=("qid",))


def _error(what: str, keys: list[str]) -> Column:
    return F.raise_error(F.concat(F.lit(f"duplicate document in {what}: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))).cast("boolean")


def unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """One row per key with the other columns; fails the query if a key repeats."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], F.count(F.lit(1)).alias("_n"))
    return g.where(F.when(F.col("_n") > 1, _error(what, keys)).otherwise(F.lit(True))).select(*df.columns)


def _order(docno_desc: bool = True) -> list[Column]:
    """By sim as a float descending, ties by docno descending (or ascending)."""
    return [F.col("sim").cast("float").desc(), F.col("docno").desc() if docno_desc else F.col("docno").asc()]


def rank_run(run: DataFrame, max_docs: int = 2**31 - 1, docno_desc: bool = True) -> DataFrame:
    """``qid, docno, sim, rank``: rank by sim (as float) descending, ties by docno descending (or ascending)."""
    r = unique(run.select("qid", "docno", "sim"), ["qid", "docno"], "run")
    return running(r, ["qid"], _order(docno_desc), {"rank": F.lit(1)}, largest_group(run, ["qid"])).where(F.col("rank") <= max_docs)


def matched(run: DataFrame, qrels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, docno, sim, rel``: the run's documents, per key of their query's judgments, with their judgment if any."""
    if keys == ["qid"]:
        kind = qrels.schema["rel"].dataType
        one, none = F.lit(1), F.lit(0)
        both = run.select("qid", "docno", F.col("sim").cast("float").alias("sim"), F.lit(None).cast(kind).alias("rel"), one.alias("_r"), none.alias("_q"))
        both = both.unionByName(qrels.select("qid", "docno", F.lit(None).cast("float").alias("sim"), "rel", none.alias("_r"), one.alias("_q")))
        g = both.groupBy("qid", "docno").agg(F.max("sim").alias("sim"), F.max("rel").alias("rel"), F.sum("_r").alias("_r"), F.sum("_q").alias("_q"))
        # one expression, so that no part of it can be tested before the errors
        kept = F.when(F.col("_r") > 1, _error("run", ["qid", "docno"])).when(F.col("_q") > 1, _error("judgments", ["qid", "docno"])).otherwise(F.col("_r") == 1)
        return g.where(kept).select("qid", "docno", "sim", "rel")
    q = unique(qrels.select(*keys, "docno", "rel"), [*keys, "docno"], "judgments")
    r = unique(run.select("qid", "docno", "sim"), ["qid", "docno"], "run")
    return r.join(qrels.select(*keys).distinct(), "qid").join(q, [*keys, "docno"], "left").select(*keys, "docno", "sim", "rel")


def judge(run: DataFrame, qrels: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Per retrieved document of a judged query: ``keys, docno, r, rel, is_rel, c, nonrel_above, pool_above, n`` and the
    query's judgment_stats().

    ``keys`` is (qid) or (qid, jg). rel is NOT_IN_POOL without a judgment and UNJUDGED for a negative one. c counts the
    relevant documents down to r; the ``_above`` columns count strictly above it. A document that repeats within a
    query, in the run or in the judgments, fails the query.
    """
    keys = list(cfg.keys)
    largest = largest_group(run, ["qid"])
    rel = F.when(F.col("rel").isNull(), NOT_IN_POOL).when(F.col("rel") < 0, UNJUDGED).otherwise(F.col("rel"))
    rows = matched(run, qrels, keys).join(judgment_stats(qrels, cfg), keys).withColumn("rel", rel)
    kept = (F.col("rel") >= 0) if cfg.judged_only else F.lit(True)
    is_rel = (F.col("rel") >= cfg.level).cast("int")
    nonrel = ((F.col("rel") >= 0) & (F.col("rel") < cfg.level)).cast("int")
    pool = ((F.col("rel") != NOT_IN_POOL) & kept).cast("int")
    rows = running(rows, keys, _order(), {"_rank": F.lit(1), "r": kept.cast("int"), "c": is_rel, "_non": nonrel, "_pool": pool}, largest)
    rows = rows.where((F.col("_rank") <= cfg.max_docs) & kept).select(
        *keys, "docno", "r", "rel", is_rel.alias("is_rel"), "c", (F.col("_non") - nonrel).alias("nonrel_above"), (F.col("_pool") - pool).alias("pool_above"), "n_rel", "n_nonrel", "n_pos",
    )
    if largest <= positions.SPLIT:
        return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    rows = materialise(rows)
    return rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)


def gain_of(rel: Column, gains: dict[int, float]) -> Column:
    """Gain of a relevance level: as given, else the level itself; nothing for unjudged documents unless given."""
    g = F.when(rel < 0, F.lit(0.0)).otherwise(rel.cast("double"))
    for level, gain in gains.items():
        g = F.when(rel == level, F.lit(float(gain))).otherwise(g)
    return g


def judgment_stats(qrels: DataFrame, cfg: EvalConfig) -> DataFrame:
    """Per judged query: ``keys, n_rel`` relevant, ``n_nonrel`` judged nonrelevant, ``n_pos`` with a relevance above 0."""
    rel = F.col("rel")
    return qrels.groupBy(*cfg.keys).agg(
        F.sum((rel >= cfg.level).cast("long")).alias("n_rel"),
        F.sum(((rel >= 0) & (rel < cfg.level)).cast("long")).alias("n_nonrel"), F.sum((rel > 0).cast("long")).alias("n_pos"),
    )


def ideal_stats(qrels: DataFrame, cfg: EvalConfig, gains: dict[int, float], cutoffs: list[int], name: str) -> DataFrame:
    """Per judged query one struct column ``name`` on its ideal ranking: ``npos, total`` (sum of gains), ``idcg``,
    ``idcg_p`` (with the other discount), ``at<k>`` for each cutoff, and per level of gain, from the best, ``levels:
    array<struct<m, gain, idcg>>`` with the rank m the level ends at. Levels are few."""
    keys = list(cfg.keys)
    pos = qrels.select(*keys, "docno", gain_of(F.col("rel"), gains).alias("g")).where("g > 0")
    pos = running(pos, keys, [F.col("g").desc(), F.col("docno").asc()], {"i": F.lit(1)}, largest_group(qrels, keys))
    d = F.col("g") / F.log2(F.col("i") + 1)
    dp = F.when(F.col("i") > 1, F.col("g") / F.log2(F.col("i").cast("double"))).otherwise(F.col("g"))
    per_level = pos.groupBy(*keys, "g").agg(
        F.count(F.lit(1)).alias("n"), F.sum(d).alias("d"), F.sum(dp).alias("dp"), *[F.sum(F.when(F.col("i") <= k, d)).alias(f"at{k}") for k in cutoffs]
    )
    lw = Window.partitionBy(*keys).orderBy(F.desc("g"))
    run = per_level.withColumns({"m": F.sum("n").over(lw), "cum": F.sum("d").over(lw)})
    level = F.struct(F.col("m"), F.col("g").alias("gain"), F.col("cum").alias("idcg"))
    return run.groupBy(*keys).agg(
        F.struct(
            F.sum("n").alias("npos"), F.sum(F.col("n") * F.col("g")).alias("total"), F.sum("d").alias("idcg"), F.sum("dp").alias("idcg_p"),
            *[F.sum(f"at{k}").alias(f"at{k}") for k in cutoffs], F.sort_array(F.collect_list(level)).alias("levels"),
        ).alias(name)
    )
