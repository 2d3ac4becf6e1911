"""One ranking out of several scores that are on different scales.

Method: ideal-point ranking. The ranks of each engine are winsorised, divided by the length of their vector, and each
document is placed by its weighted distances to the ideal and to the anti-ideal point; the relative closeness to the
ideal gives the ranking. No engine can weigh more because its scale is longer.

The majority winner of a query is found with that ranking. Its top document is the pivot: whoever wins is the pivot
itself or ahead of it, so only those stay: few, if the ranking is good. What is left (all of it, where documents beat
each other in circles) is walked through in the order of the ranking in bounded chunks, which leaves one document per
query, and an exact check of that one against all others decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from rankspark.operators.positions import largest_group
from rankspark.plans.stage import materialise, maybe_broadcast

CHUNK = 256
TASK_ROWS = 50_000  # rows of one query that one task is to work on


def splits_of(rows: DataFrame, qid: str = "qid") -> int:
    """Into how many tasks one query's rows, and one document's rows, are dealt: by the rows of the largest query."""
    return max(1, -(-largest_group(rows.select(qid), [qid]) // TASK_ROWS))


def best_ranks(rows: DataFrame, splits: int, qid: str = "qid", doc: str = "doc_id", ranks: str = "ranks") -> DataFrame:
    """``qid, bucket, doc_id, ranks map<int,int>``: a document's smallest valid rank per engine. A rank that is null or
    below 1 is none; a document without any has an empty map. Rows without qid or document are dropped.

    Whole maps are shuffled, not single ranks: first dealt by document and a salt, so that a document in very many
    rows is merged in several tasks, then by query and bucket, so that a query with very many documents is split.
    """
    valid = F.filter(F.map_entries(ranks), lambda e: e["value"] >= 1)
    rows = rows.where(F.col(qid).isNotNull() & F.col(doc).isNotNull()).select(F.col(qid).alias("qid"), F.col(doc).alias("doc_id"), F.coalesce(valid, F.array().cast("array<struct<key:int,value:int>>")).alias("es"))

    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        """Smallest rank per engine; ``df`` is partitioned by what ``by`` holds, so nothing is shuffled."""
        long = df.select(*by, F.explode_outer("es").alias("e"))
        per = long.groupBy(*by, F.col("e.key").alias("key")).agg(F.min("e.value").alias("value"))
        return per.groupBy(*by).agg(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))).alias("es"))

    done = F.map_from_entries(F.sort_array("es")).alias("ranks")
    if splits == 1:
        return merged(rows.repartition("qid", "doc_id"), ["qid", "doc_id"]).select("qid", F.lit(0).alias("bucket"), "doc_id", done)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("es"), F.lit(splits))).repartition("qid", "doc_id", "_salt")
    once = merged(salted, ["qid", "doc_id", "_salt"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(splits)))
    return merged(once.repartition("qid", "bucket"), ["qid", "bucket", "doc_id"]).select("qid", "bucket", "doc_id", done)


def query_stats(docs: DataFrame, rows: DataFrame, tail: float = 0.05, qid: str = "qid", ranks: str = "ranks") -> DataFrame:
    """Per query: number of documents, number of engines named in any map, and per engine what the distances need:
    ``stats map<engine, struct<lo, hi, worst, anti, norm>>`` (as long as there are engines)."""
    long = docs.select("qid", F.explode("ranks").alias("engine", "rank"))
    cut = long.groupBy("qid", "engine").agg(F.percentile_approx("rank", [tail, 1 - tail], 1000).alias("q"))
    cuts = cut.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("engine", "q"))).alias("cuts"))
    # The clip bounds come to the documents as one map per query, so that only sums are shuffled afterwards.
    held = docs.join(maybe_broadcast(materialise(cuts)), "qid").select("qid", F.explode("ranks").alias("engine", "rank"), "cuts").withColumn("q", F.col("cuts")[F.col("engine")])
    clipped = F.least(F.greatest(F.col("rank"), F.col("q")[0]), F.col("q")[1]).cast("double")
    sums = held.groupBy("qid", "engine").agg(F.sum(clipped * clipped).alias("sq"), F.count(F.lit(1)).alias("n"), F.first("q").alias("q"))
    sizes = docs.groupBy("qid").agg(F.count(F.lit(1)).alias("n_docs"))
    named = rows.where(F.col(qid).isNotNull()).select(F.col(qid).alias("qid"), F.explode(F.map_keys(ranks)).alias("engine")).groupBy("qid").agg(F.collect_set("engine").alias("named"))
    lo, hi = F.col("q")[0].cast("double"), F.col("q")[1].cast("double")
    worst = hi + 1  # where an engine has not ranked a document
    missing = F.col("n_docs") - F.col("n")
    entry = F.struct(
        "engine",
        F.struct(lo.alias("lo"), hi.alias("hi"), worst.alias("worst"), F.when(missing > 0, worst).otherwise(hi).alias("anti"), F.sqrt(F.col("sq") + missing * worst * worst).alias("norm")).alias("s"),
    )
    stats = sums.join(sizes, "qid").groupBy("qid").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("stats"))
    return sizes.join(named, "qid", "left").join(stats, "qid", "left").select("qid", "n_docs", F.coalesce(F.size("named"), F.lit(0)).alias("n_engines"), "stats")


def _distance(ranks: Column, stats: Column, to: str) -> Column:
    """Distance to the ideal (each engine's best) or anti-ideal point; engines weigh the same."""

    def part(e: Column) -> Column:
        s, r = e["value"], ranks[e["key"]]
        # least and greatest pass over nulls, so a missing rank must be told apart first.
        v = F.when(r.isNull(), s["worst"]).otherwise(F.least(F.greatest(r.cast("double"), s["lo"]), s["hi"]))
        d = (v - s[to]) / s["norm"]
        return d * d

    return F.sqrt(F.aggregate(F.transform(F.map_entries(stats), part), F.lit(0.0), lambda a, x: a + x))


def closeness(rows: DataFrame, tail: float = 0.05) -> DataFrame:
    """``qid, doc_id, ranks, closeness, n_docs, n_engines``; closeness in [0, 1], 1 at the ideal point. Where all
    documents are alike (or no engine ranked any) it is 0.5. Ties are left to the caller's order (by doc_id)."""
    docs = materialise(best_ranks(rows, splits_of(rows)))
    stats = materialise(query_stats(docs, rows, tail))
    # One row of stats per query: it goes to the documents if it is small; else, where one query has very many documents,
    # the document side is split (adaptive skew join).
    j = docs.join(maybe_broadcast(stats), "qid")
    plus, minus = _distance(F.col("ranks"), F.col("stats"), "lo"), _distance(F.col("ranks"), F.col("stats"), "anti")
    j = j.withColumns({"_p": plus, "_m": minus})
    c = F.when(F.coalesce(F.col("_p") + F.col("_m"), F.lit(0.0)) > 0, F.col("_m") / (F.col("_p") + F.col("_m"))).otherwise(0.5)
    return j.select("qid", "doc_id", "ranks", c.alias("closeness"), "n_docs", "n_engines")


def ahead(a: Column, b: Column) -> Column:
    """In how many engines the document with ranks ``a`` is ahead of that with ranks ``b``."""
    return F.size(F.filter(F.map_entries(a), lambda e: F.coalesce(e["value"] < b[e["key"]], F.lit(True))))


def _champion(docs: Column) -> Column:
    """The last one standing of an array of documents ordered by the ranking."""
    return F.aggregate(docs, F.get(docs, F.lit(0)), lambda c, d: F.when(ahead(c["ranks"], d["ranks"]) * 2 > d["n_engines"], c).when(c["doc_id"] == d["doc_id"], c).otherwise(d))


def _beats(ranks: str, other: str) -> Column:
    return ahead(F.col(ranks), F.col(other)) * 2 > F.col("n_engines")


def narrowed(ranked: DataFrame) -> DataFrame:
    """What can win: each query's first document by closeness (the pivot; ties by doc_id) and all that are ahead of it."""
    pivot = ranked.groupBy("qid").agg(F.max_by(F.struct("doc_id", "ranks"), F.struct("closeness", "doc_id")).alias("_p"))
    pivot = maybe_broadcast(materialise(pivot.select("qid", F.col("_p.doc_id").alias("_pivot"), F.col("_p.ranks").alias("_ranks"))))
    j = ranked.join(pivot, "qid").where((F.col("doc_id") == F.col("_pivot")) | _beats("ranks", "_ranks"))
    return j.select("qid", "doc_id", "ranks", "closeness", "n_engines")


def _walk(left: DataFrame) -> DataFrame:
    """One document per query that beats those it met on a walk along the ranking, in a tree of bounded chunks."""
    size = largest_group(left, ["qid"])
    level = left.withColumn("_left", F.lit(size))
    if size > CHUNK:
        level = left.join(left.groupBy("qid").agg(F.count(F.lit(1)).alias("_left")), "qid")
    for k in range(max(1, math.ceil(math.log(max(size, 2), CHUNK / 4)))):
        # Chunks by hash, a quarter full on average, so that none is larger than about CHUNK.
        chunks = F.greatest(F.ceil(F.col("_left") / (CHUNK / 4)), F.lit(1)).cast("bigint")
        chunks = F.when(F.col("_left") <= CHUNK, F.lit(1)).otherwise(chunks)
        level = level.withColumn("_chunks", chunks).withColumn("_chunk", F.pmod(F.xxhash64("doc_id", F.lit(k)), F.col("_chunks")))
        doc = F.struct((-F.col("closeness")).alias("key"), "doc_id", F.map_entries("ranks").alias("entries"), "n_engines")
        packs = level.groupBy("qid", "_chunk", "_chunks").agg(F.sort_array(F.collect_list(doc)).alias("docs"))
        docs = F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), F.map_from_entries(d["entries"]).alias("ranks"), d["n_engines"].alias("n_engines"), (-d["key"]).alias("closeness")))
        level = packs.withColumn("docs", docs).withColumn("c", _champion(F.col("docs"))).select("qid", "c.*", F.col("_chunks").alias("_left"))
    return level


def majority_winners(ranked: DataFrame, narrow: bool = True) -> DataFrame:
    """``qid, doc_id``: the document, if there is one, that is ahead of every other of its query in more than half of
    the query's engines. ``ranked`` is the result of closeness(). Queries with one document give none."""
    ranked = materialise(ranked.where("n_docs > 1"))
    left = materialise(narrowed(ranked)) if narrow else ranked.select("qid", "doc_id", "ranks", "closeness", "n_engines")
    one = maybe_broadcast(materialise(_walk(left).select("qid", F.col("doc_id").alias("_best"), F.col("ranks").alias("_ranks"))))
    beaten = F.col("_best").eqNullSafe(F.col("doc_id")) | _beats("_ranks", "ranks")
    return ranked.join(one, "qid").groupBy("qid", "_best").agg(F.min(beaten).alias("_all")).where("_all").select("qid", F.col("_best").alias("doc_id"))
