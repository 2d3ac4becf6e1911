"""Mixing sources to target weights.

Method: Pareto order sampling. A source's target is met with as many certain whole copies of its documents as fit;
the remainder is a sample of fixed size with unequal inclusion probabilities (in proportion to the documents' tokens):
each document gets random odds divided by its inclusion odds, and those of the lowest quotients are taken. The order
within a source comes from a range-partitioned sort with exact positions, so no source is gathered in one task.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rankspark.functions.text import is_blank, name_key
from rankspark.llm.pack import TOKENIZER, token_counts
from rankspark.operators.positions import exact_positions
from rankspark.plans.stage import materialise, maybe_broadcast


def solve_inclusion(tokens: np.ndarray, n: np.ndarray, budget: float) -> tuple[float, int]:
    """c and the sample size such that inclusion probabilities min(1, c x tokens) spend ``budget`` tokens on average."""
    order = np.argsort(-tokens)
    t, k = tokens[order].astype(float), n[order].astype(float)
    whole = np.concatenate([[0.0], np.cumsum(k * t)])  # tokens of the largest sizes, taken for certain
    square = np.concatenate([np.cumsum((k * t * t)[::-1])[::-1], [0.0]])
    for i in range(len(t) + 1):
        left = budget - whole[i]
        c = left / square[i] if square[i] > 0 else 0.0
        if i == len(t) or c * t[i] <= 1 or left <= 0:
            break
    c = max(c, 0.0)
    pi = np.where(np.arange(len(t)) < i, 1.0, np.minimum(1.0, c * t))
    return (c if i == 0 or c > 0 else 1.0 / max(t[i - 1], 1.0)), int(round(float((k * pi).sum())))


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    c, size = solve_inclusion(pdf["tokens"].to_numpy(), pdf["n"].to_numpy(), float(pdf["remainder"].iloc[0]))
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "c": [c], "size": [size]})


def _uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) that depends on the row's columns and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row of ``targets``: ``source, key, weight, max_repeats, share, n_docs, available, corpus, target, allocated,
    copies, remainder, short``.

    Sources are the same if they differ only in case, white space, hyphens and underscores. ``target`` is the share of
    all tokens (those of no or an unlisted source included); ``allocated`` is at most max_repeats times what is there;
    short where that is less than the target. Null weights and repeats count as 0; a source without documents has 0 tokens.
    """
    corpus = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    weights = targets.select("source", name_key(F.col("source")).alias("key"), F.coalesce(F.col("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.col("max_repeats"), F.lit(0)).alias("max_repeats"))
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    have = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("available"))
    j = weights.join(have, "key", "left").na.fill(0, ["n_docs", "available"])
    share = F.col("weight") / F.lit(total) if total else F.lit(0.0)
    j = j.withColumns({"share": share, "corpus": F.lit(corpus).cast("bigint")}).withColumn("target", F.col("share") * F.col("corpus"))
    cap = F.col("max_repeats") * F.col("available")
    j = j.withColumns({"short": cap < F.col("target"), "allocated": F.least(cap.cast("double"), F.col("target"))})
    copies = F.when(F.col("available") > 0, F.floor(F.col("allocated") / F.col("available"))).otherwise(0)
    copies = F.least(copies.cast("int"), F.col("max_repeats"))
    return j.withColumn("copies", copies).withColumn("remainder", F.col("allocated") - F.col("copies") * F.col("available"))


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 42, key: str = "doc_id", source: str = "source", tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix (``doc_id, source, tokens, copies``: how often each document is used, at least once) and its report.

    The report has a row per row of ``targets``: what was asked for, what the mix reached (``n_used, used_tokens,
    reached_share`` of the corpus, ``mix_share`` of the mix), and ``short``. A source that falls short isn't made up
    for by others, so that none exceeds its share; a mix with short sources is smaller than the corpus. Documents
    without tokens, of no source or an unlisted one are not used.
    """
    sizes = token_counts(docs, key, keep=(source,), tokenizer=tokenizer)
    sizes = materialise(sizes.select(F.col(key).alias("doc_id"), F.when(~is_blank(F.col(source)), name_key(F.col(source))).alias("key"), "tokens"))
    plan = materialise(source_targets(sizes, targets))
    each = maybe_broadcast(plan.where("available > 0 and allocated > 0").select("source", "key", "copies", "remainder"))
    used = sizes.where("tokens > 0").join(each, "key")
    # The rows of a source are as many as it has different text sizes.
    hist = used.where("remainder > 0").groupBy("key", "remainder", "tokens").agg(F.count(F.lit(1)).alias("n"))
    solved = materialise(hist.groupBy("key").applyInPandas(_solve, "key string, c double, size bigint"))
    drawn = used.where("remainder > 0").join(maybe_broadcast(solved), "key")
    pi = F.least(F.col("c") * F.col("tokens"), F.lit(1.0))
    u = _uniform(seed, "doc_id")
    odds = F.when(pi >= 1.0, -1.0).otherwise((u / (1 - u)) / (pi / (1 - pi)))
    placed = exact_positions(drawn.select("doc_id", "key", "size", odds.alias("odds")), ["key"], [F.col("odds").asc(), F.col("doc_id").asc()], F.col("size"))
    extra = placed.select("doc_id", "key", F.lit(1).alias("extra"))
    mix = used.join(extra, ["doc_id", "key"], "left").select("doc_id", "source", "key", "tokens", (F.col("copies") + F.coalesce("extra", F.lit(0))).alias("copies")).where("copies > 0")
    mix = materialise(mix)
    got = mix.groupBy("key").agg(F.count(F.lit(1)).alias("n_used"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    size = mix.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    r = plan.join(got, "key", "left").na.fill(0, ["n_used", "used_tokens", "most_copies"])
    r = r.withColumns({"reached_share": F.try_divide(F.col("used_tokens").cast("double"), F.col("corpus")), "mix_share": F.try_divide(F.col("used_tokens").cast("double"), F.lit(size))})
    return mix.drop("key"), r.drop("key")
