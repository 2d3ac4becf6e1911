"""One surviving record for each group of duplicates, chosen field by field.

Method: Bayesian fusion with copy detection. Every source claims values for the fields of a record. The accuracy of a
source and the dependence of each pair of sources are estimated together with the truth: sources that share false
values are likely to copy, a copied vote is discounted, and the value with the greatest posterior is the true one.
A strict order on the rows (trust, recency, identifier) can be put before the votes as a prior that outweighs them.

All claims vote: a source that claims several values of a field in one group shares its vote between them, by rows.
Nothing but its sources is gathered per group: the unit of work is a value of a field of a group with the sources that
claim it; groups meet only in sums and maxima. Up to MAX_SOURCES the sources' figures are arrays that go with the tasks;
where there are more, the same figures are tables, of sources and of pairs that meet in a group, and are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankspark.functions.text import WS, trim_ws
from rankspark.operators.packed import split_packed
from rankspark.operators.pairs import dealt
from rankspark.plans.stage import materialise, maybe_broadcast, numbered, written

MAX_SOURCES = 100  # sources whose figures are arrays: dependences are MAX_SOURCES^2 numbers, and exp(all votes) fits a double
ROUNDS = 4
FALSE_VALUES = 10.0  # assumed number of wrong values a field can take
COPY_RATE, PRIOR_DEPENDENT = 0.8, 0.1
POOLED, NONE = "(others)", "(none)"
FIELDS = {"title": False, "abstract": False, "pmc_json_files": True}  # True: several values packed in the field


def value_or_null(field: str, stand_ins: list[str], packed: bool) -> Column:
    """A comparable form of a field's value, null where it has none: text without regard to case and spacing, or for
    packed fields the list of its values."""
    c = F.col(field)
    if packed:
        joined = F.array_join(split_packed(c, stand_ins), "\n")  # no value is empty
        return F.nullif(joined, F.lit(""))
    t = F.regexp_replace(F.lower(trim_ws(c)), f"{WS}{{2,}}+|(?! ){WS}", " ")
    return F.nullif(t if not stand_ins else F.when(t.isin([*stand_ins, ""]), "").otherwise(t), F.lit(""))


def _by_rows(rows: DataFrame, source: str) -> DataFrame:
    s = rows.select(F.lower(trim_ws(F.col(source))).alias("_s")).where("_s is not null and _s != ''").groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    return s.orderBy(F.desc("_n"), "_s").select("_s")


def source_names(rows: DataFrame, source: str) -> list[str]:
    """The sources by number of rows, the first MAX_SOURCES - 2, then POOLED for the rest and NONE for rows without a
    source. Where there is a rest, all_sources() has each of them and nothing is counted as POOLED."""
    return [r[0] for r in _by_rows(rows, source).limit(MAX_SOURCES - 2).collect()] + [POOLED, NONE]


def all_sources(rows: DataFrame, source: str) -> DataFrame:
    """``_s, src``: every source, numbered in the order of source_names()."""
    return numbered(_by_rows(rows, source), "src")


def claims(rows: DataFrame, key: str, fields: dict[str, bool], stand_ins: list[str], trust: DataFrame, names: list[str], row_id: str, source: str, at: str, register: DataFrame | None = None, n: int = 0) -> DataFrame:
    """One row per group, field, source and value: ``key, field_name, src, vh, n`` (rows) and ``best``, the first of
    those rows by the strict order. vh is null for rows without a value of the field. The numbers of the sources are
    their places in ``names`` or, if it is given, those of the register; ``n`` - 1 is then that of rows without one."""
    k, s = F.lower(trim_ws(F.col(key))), F.lower(trim_ws(F.col(source)))
    known = F.create_map(*[x for i, n in enumerate(names[:-2]) for x in (F.lit(n), F.lit(i))]) if names[:-2] else F.create_map().cast("map<string,int>")
    src = F.when(F.coalesce(s == "", F.lit(True)), len(names) - 1).otherwise(F.coalesce(known[s], F.lit(len(names) - 2)))
    per_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), value_or_null(f, stand_ins, p).alias("value")) for f, p in fields.items()]))
    # what is joined is the register of trusted sources
    base = rows.where(k.isNotNull() & (k != "")).select(
        k.alias(key), s.alias("_s"), src.cast("int").alias("src"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62))).alias("at"), F.col(row_id).alias("row"), per_field.alias("c"),
    ).join(trust, "_s", "left")
    if register is not None:
        base = base.drop("src").join(register, "_s", "left").withColumn("src", F.coalesce("src", F.lit(n - 1)))
    best = F.struct(F.coalesce(F.col("trust").cast("long"), F.lit(-(2**62))).alias("trust"), "at", (-F.col("row")).alias("neg"), "row")
    return base.groupBy(key, F.col("c.field_name").alias("field_name"), "src", F.when(F.col("c.value").isNotNull(), F.xxhash64("c.value")).alias("vh")).agg(F.count(F.lit(1)).alias("n"), F.max(best).alias("best"))


def _shares(pdf: pd.DataFrame, n: int) -> np.ndarray:
    """Rows x sources: the part of a source's vote that goes to the row's value."""
    w = np.zeros((len(pdf), n))
    sizes = pdf["srcs"].map(len).to_numpy()
    if len(sizes):
        w[np.repeat(np.arange(len(pdf)), sizes), np.concatenate(pdf["srcs"].to_numpy())] = np.concatenate(pdf["shares"].to_numpy())
    return w


def vote_scores(w: np.ndarray, acc: np.ndarray, dep: np.ndarray) -> np.ndarray:
    """Sum of the votes for each row's value: log(FALSE_VALUES acc / (1 - acc)) per source, less what is likely to be
    copied from better sources that claim the same value."""
    order = np.argsort(-acc, kind="stable")
    better = np.zeros((len(acc), len(acc)), bool)
    better[np.ix_(order, order)] = np.tri(len(acc), k=-1, dtype=bool)
    copied = np.where(better, np.log(1 - COPY_RATE * dep), 0.0)
    independent = np.exp((w > 0) @ copied.T)
    return (w * independent) @ np.log(FALSE_VALUES * acc / (1 - acc))


def _scored(n: int, acc: np.ndarray, dep: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=["srcs", "shares"]).assign(score=vote_scores(_shares(pdf, n), acc, dep))

    return run


def _statistics(n: int, acc: np.ndarray, dep: np.ndarray):
    """Sums over the values: per source the posterior of its claims and their number, per pair what they share that is
    true and what they share that is false."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros((4, n, n))
        for pdf in batches:
            w = _shares(pdf, n)
            post = np.exp(vote_scores(w, acc, dep)) / pdf["z"].to_numpy()
            true = w.T @ (w * post[:, None])
            s[0] += np.diag(post @ w)
            s[1] += np.diag(w.sum(axis=0))
            s[2] += true
            s[3] += w.T @ w - true
        flat = s.ravel()
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"i": at, "x": flat[at]})

    return run


def _together(n: int):
    """In how many groups each two sources both claim a value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros((n, n))
        for pdf in batches:
            w = np.zeros((len(pdf), n))
            if len(pdf):
                w[np.repeat(np.arange(len(pdf)), pdf["srcs"].map(len).to_numpy()), np.concatenate(pdf["srcs"].to_numpy())] = 1.0
            s += w.T @ w
        flat = s.ravel()
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"i": at, "x": flat[at]})

    return run


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():  # at most 4 MAX_SOURCES^2 numbers
        out[r.i] = r.x
    return out


def _dependent(shared_true: np.ndarray, shared_false: np.ndarray, different: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Posterior probability that two sources of mean accuracy ``a`` are dependent, from what they share."""
    pt, pf = a * a, (1 - a) ** 2 / FALSE_VALUES
    pd_ = np.maximum(1 - pt - pf, 1e-9)
    ct, cf = COPY_RATE * a + (1 - COPY_RATE) * pt, COPY_RATE * (1 - a) + (1 - COPY_RATE) * pf
    cd = np.maximum((1 - COPY_RATE) * pd_, 1e-9)
    log = shared_true * np.log(ct / pt) + shared_false * np.log(cf / pf) + different * np.log(cd / pd_)
    odds = np.log(PRIOR_DEPENDENT / (1 - PRIOR_DEPENDENT)) + log
    return 1 / (1 + np.exp(np.clip(-odds, -500, 500)))


def dependence(shared_true: np.ndarray, shared_false: np.ndarray, different: np.ndarray, acc: np.ndarray) -> np.ndarray:
    """Posterior probability that two sources are dependent, for each pair."""
    dep = _dependent(shared_true, shared_false, different, np.sqrt(acc[:, None] * acc[None, :]))
    np.fill_diagonal(dep, 0)
    return dep


def _mass(score: Column, n_values: Column, top: Column) -> Column:
    """What the posteriors of a field's values are divided by: theirs, and that of the values no one claims; all of it
    by exp(top), a number per field that keeps exp(score - top) within a double."""
    return F.sum(F.exp(score - top)) + F.greatest(F.lit(FALSE_VALUES + 1) - n_values, F.lit(0.0)) * F.exp(-F.max(top))


def learn_sources(values: DataFrame, groups: DataFrame, n: int, key: str, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Accuracy of each source and dependence of each pair, from the fields of groups that several sources claim: where
    one source stands alone nothing contradicts it, so it would only repeat what was assumed."""
    by = [key, "field_name"]
    several = materialise(groups.where("n_sources > 1").select(*by, "srcs"))
    both = _summed(several.select("srcs").mapInPandas(_together(n), "i int, x double"), n * n).reshape(n, n)
    held = materialise(values.join(several.select(*by), by).select(*by, "srcs", "shares"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields if f.name in by)
    acc, dep = np.full(n, 0.8), np.zeros((n, n))
    for _ in range(rounds):
        z = held.mapInPandas(_scored(n, acc, dep), f"{kind}, score double").groupBy(*by).agg(_mass(F.col("score"), F.count(F.lit(1)), F.lit(0.0)).alias("z"))
        s = _summed(held.join(z, by).select("srcs", "shares", "z").mapInPandas(_statistics(n, acc, dep), "i int, x double"), 4 * n * n).reshape(4, n, n)
        acc = np.round(np.clip((np.diag(s[0]) + 1.6) / (np.diag(s[1]) + 2), 0.05, 0.99), 12)  # equals stay equal in whatever order they were summed
        dep = dependence(s[2], s[3], np.maximum(both - s[2] - s[3], 0.0), acc)
    return acc, dep


def _pairs(held: DataFrame, keys: list[str]) -> DataFrame:
    """Each two sources of the same keys, the smaller number first: ``i, j`` and ``w``, the product of their shares."""
    a = held.select(*keys, F.col("src").alias("i"), F.col("share").alias("_wi"))
    b = held.select(*keys, F.col("src").alias("j"), F.col("share").alias("_wj"))
    a, b, on = dealt(a, b, keys, "i")
    return a.join(b, on).where("i < j").select(*keys, "i", "j", (F.col("_wi") * F.col("_wj")).alias("w"))


def _pair_dependence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per pair its dependence, and what vote_scores() takes from the vote of the worse of the two."""
    for p in batches:
        dep = _dependent(p["true"], p["same"] - p["true"], np.maximum(p["both"] - p["same"], 0.0), np.sqrt(p["acc_i"] * p["acc_j"]))
        yield pd.DataFrame({"i": p["i"], "j": p["j"], "dep": dep, "copied": np.log(1 - COPY_RATE * dep), "worse": np.where(p["acc_i"] >= p["acc_j"], p["j"], p["i"])})


def _joined_scores(held: DataFrame, pairs: DataFrame, acc: DataFrame, dep: DataFrame | None, by: list[str]) -> DataFrame:
    """vote_scores() from tables: ``vid, score`` of each value, and ``top`` for _mass()."""
    votes = held.join(acc, "src")
    if dep is None:
        votes = votes.withColumn("copied", F.lit(0.0))
    else:
        copied = pairs.join(dep.select("i", "j", "copied", "worse"), ["i", "j"]).groupBy("vid", F.col("worse").alias("src")).agg(F.sum("copied").alias("copied"))
        votes = votes.join(copied, ["vid", "src"], "left")
    vote = F.col("share") * F.exp(F.coalesce("copied", F.lit(0.0))) * F.log(FALSE_VALUES * F.col("acc") / (1 - F.col("acc")))
    scored = materialise(votes.groupBy(*by, "vid").agg(F.sum(vote).alias("score")))
    return scored.join(scored.groupBy(*by).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("top")), by)


def score_many_sources(values: DataFrame, groups: DataFrame, n: int, key: str, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """learn_sources() and the scores for any number of sources: ``vid, score, top`` of the values, ``src, acc`` of the
    ``n`` sources and ``i, j, dep`` of the pairs that meet in a group. Nothing comes to the driver. Pairs that don't
    meet have the prior dependence, which no vote asks for."""
    by = [key, "field_name"]
    held = materialise(
        values.join(groups.select(*by, "n_sources"), by).select(*by, "vid", "n_sources", F.size("srcs").alias("n_held"), F.explode(F.arrays_zip("srcs", "shares")).alias("c"))
        .select(*by, "vid", "n_sources", "n_held", F.col("c.srcs").alias("src"), F.col("c.shares").alias("share"))
    )
    several = held.where("n_sources > 1")
    pairs = written(_pairs(held.where("n_held > 1"), ["vid"]))
    both = _pairs(groups.where("n_sources > 1").select(*by, F.explode("srcs").alias("src"), F.lit(1.0).alias("share")), by).groupBy("i", "j").agg(F.sum("w").alias("both"))
    met = written(both.join(pairs.groupBy("i", "j").agg(F.sum("w").alias("same")), ["i", "j"], "left").fillna(0.0, ["same"]))
    every = values.sparkSession.range(n).withColumnRenamed("id", "src")
    acc, dep = every.withColumn("acc", F.lit(0.8)), None
    for _ in range(rounds):
        scored = _joined_scores(several, pairs, acc, dep, by)
        z = scored.groupBy(*by).agg(_mass(F.col("score"), F.count(F.lit(1)), F.col("top")).alias("z"))
        post = materialise(scored.join(z, by).select("vid", (F.exp(F.col("score") - F.col("top")) / F.col("z")).alias("post")))
        told = several.join(post, "vid").groupBy("src").agg(F.sum(F.col("share") * F.col("post")).alias("a"), F.sum("share").alias("b"))
        mean = (F.coalesce("a", F.lit(0.0)) + 1.6) / (F.coalesce("b", F.lit(0.0)) + 2)
        acc = materialise(every.join(told, "src", "left").select("src", F.round(F.greatest(F.least(mean, F.lit(0.99)), F.lit(0.05)), 12).alias("acc")))
        true = pairs.join(post, "vid").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("post")).alias("true"))
        seen = met.join(true, ["i", "j"], "left").fillna(0.0, ["true"])
        for x in ("i", "j"):
            seen = seen.join(acc.select(F.col("src").alias(x), F.col("acc").alias(f"acc_{x}")), x)
        dep = written(seen.mapInPandas(_pair_dependence, "i long, j long, dep double, copied double, worse long"))
    scored = _joined_scores(held, pairs, acc, dep, by).select("vid", "score", "top")
    return scored, acc, met.select("i", "j", F.lit(0.0).alias("dep")) if dep is None else dep.select("i", "j", "dep")


def fuse_records(
    rows: DataFrame, source_trust: DataFrame, stand_ins: list[str], key: str = "cord_uid", fields: dict[str, bool] | None = None,
    row_id: str = "row_id", source: str = "source_x", at: str = "updated_at", rounds: int = ROUNDS,
) -> tuple[DataFrame, dict]:
    """The fused records, one row per key and field with a value, and what was learnt of the sources.

    ``key, field_name, n_rows, n_sources, n_values, row_id, posterior, best_row_id, best_posterior``. Both picks are the
    value of greatest posterior, shown by its first row in the strict order (highest trust, latest, smallest row_id):
    ``row_id`` with that order as a prior which outweighs all votes, so that the votes only count between equals;
    ``best_row_id`` by the votes, the strict order deciding between equals. The posteriors are those of the votes.

    Keys are trimmed and lowered; rows with a null or blank key belong to no group. Sources are trimmed and lowered; each
    has a vote, an accuracy and dependences of its own, however many there are, and rows without a source are one. What
    was learnt is ``sources, accuracy, dependence`` as a list and arrays; beyond MAX_SOURCES these would grow with the
    data, so ``accuracy`` and ``dependence`` are tables, ``every`` is the table of the sources and their numbers, and
    ``sources`` has the largest only. Sources that are not in ``source_trust`` have the lowest trust. ``fields`` names the
    fields, True for packed ones. An empty table gives an empty result.
    """
    fields = fields or FIELDS
    by = [key, "field_name"]
    names = source_names(rows, source)
    register = all_sources(rows, source) if len(names) == MAX_SOURCES else None
    n = len(names) if register is None else register.count() + 2
    many = n > len(names)
    trust = maybe_broadcast(source_trust.select(F.lower(trim_ws(F.col("source_x"))).alias("_s"), "trust").where("_s is not null").groupBy("_s").agg(F.max("trust").alias("trust")))
    each = materialise(claims(rows, key, fields, stand_ins, trust, names, row_id, source, at, maybe_broadcast(register) if many else None, n))
    claimed = F.col("vh").isNotNull()
    groups = materialise(each.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.collect_set(F.when(claimed, F.col("src"))).alias("srcs")).withColumn("n_sources", F.size("srcs")).where("n_sources > 0"))
    votes = each.where(claimed).groupBy(*by, "src").agg(F.sum("n").alias("_all"))
    shared = each.where(claimed).join(votes, [*by, "src"]).withColumn("share", F.col("n") / F.col("_all"))
    values = materialise(shared.groupBy(*by, "vh").agg(F.collect_list(F.struct("src", "share")).alias("_c"), F.max("best").alias("best")).select(*by, "best", F.col("_c.src").alias("srcs"), F.col("_c.share").alias("shares")))
    learnt = {"sources": names}
    if many:
        values = materialise(values.withColumn("vid", F.monotonically_increasing_id()))
        scores, acc, dep = score_many_sources(values, groups, n, key, rounds)
        scored = values.select(*by, "vid", "best").join(scores, "vid")
        learnt["every"] = register.select(F.col("_s").alias("source"), "src").unionByName(rows.sparkSession.createDataFrame([(POOLED, n - 2), (NONE, n - 1)], "source string, src long"))
    else:
        acc, dep = learn_sources(values, groups, n, key, rounds)
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields if f.name not in ("srcs", "shares"))
        scored = values.mapInPandas(_scored(n, acc, dep), f"{kind}, score double").withColumn("top", F.lit(0.0))
    order = [F.col(f"best.{x}") for x in ("trust", "at", "neg")]
    picked = scored.groupBy(*by).agg(
        F.max(F.struct(*order, "score", F.col("best.row").alias("row"))).alias("p"), F.max(F.struct(F.round("score", 9).alias("r"), *order, "score", F.col("best.row").alias("row"))).alias("v"),
        F.count(F.lit(1)).alias("n_values"), _mass(F.col("score"), F.count(F.lit(1)), F.col("top")).alias("z"), F.max("top").alias("top"),
    )
    post = lambda p: F.exp(F.col(f"{p}.score") - F.col("top")) / F.col("z")
    out = groups.select(*by, "n_rows", "n_sources").join(picked, by).select(
        *by, "n_rows", "n_sources", "n_values", F.col("p.row").alias("row_id"), post("p").alias("posterior"), F.col("v.row").alias("best_row_id"), post("v").alias("best_posterior"),
    )
    return out, learnt | {"accuracy": acc, "dependence": dep}


def surviving_values(rows: DataFrame, fused: DataFrame, key: str = "cord_uid", row_id: str = "row_id", pick: str = "row_id", fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """The surviving record of each key, wide: ``key, n_rows`` and each field's value from the picked row."""
    names = sorted(fields)
    ids = fused.select(key, "field_name", "n_rows", F.col(pick).alias("_row"))
    text = F.element_at(F.create_map(*[x for f in names for x in (F.lit(f), F.col(f"_t.{f}"))]), F.col("field_name"))
    j = ids.join(rows.select(F.col(row_id).alias("_row"), F.struct(*names).alias("_t")), "_row")
    return j.groupBy(key).agg(F.max("n_rows").alias("n_rows"), *[F.max(F.when(F.col("field_name") == f, text)).alias(f) for f in names])


def source_report(spark, learnt: dict) -> DataFrame:
    """``source, accuracy, copies_of, dependence``: the learnt accuracy and the source each most depends on, the first
    of equals. Two sources that never meet have the prior dependence."""
    if "every" in learnt:
        return _joined_report(learnt)
    dep = learnt["dependence"]
    rows = [(s, float(a), learnt["sources"][int(dep[i].argmax())], float(dep[i].max())) for i, (s, a) in enumerate(zip(learnt["sources"], learnt["accuracy"], strict=True))]
    return spark.createDataFrame(rows, "source string, accuracy double, copies_of string, dependence double")


def _joined_report(learnt: dict) -> DataFrame:
    every, dep = learnt["every"], learnt["dependence"]
    met = dep.unionByName(dep.select(F.col("j").alias("i"), F.col("i").alias("j"), "dep"))
    # the first number that a source neither has nor meets: without gaps its partners and itself stand at their numbers
    known = met.select("i", "j").unionByName(every.select(F.col("src").alias("i"), F.col("src").alias("j")))
    place = known.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1)
    prior = float(_dependent(0.0, 0.0, 0.0, 0.8))
    apart = place.groupBy("i").agg(F.sum((F.col("j") == F.col("_k")).cast("long")).alias("j")).withColumn("dep", F.lit(prior))
    most = met.unionByName(apart).groupBy(F.col("i").alias("src")).agg(F.max(F.struct("dep", (-F.col("j")).alias("neg"))).alias("m"))
    named = every.select((-F.col("src")).alias("neg"), F.col("source").alias("copies_of"))
    j = every.join(learnt["accuracy"], "src").join(most, "src").select("source", F.col("acc").alias("accuracy"), "m.neg", F.col("m.dep").alias("dependence"))
    return j.join(named, "neg").select("source", "accuracy", "copies_of", "dependence")
