"""Evaluation of a run: measures per query and over all queries, as a tidy table."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from rankspark.operators import measures as M
from rankspark.operators.judge import EvalConfig, gain_of, ideal_stats, judge, judgment_stats
from rankspark.operators.positions import largest_group, running
from rankspark.plans.stage import materialise

MISSING_Z = -1000000.0  # fixed value: the score of a value without a reference
COUNTS = ("num_q", "num_ret", "num_rel", "num_rel_ret", "num_nonrel_judged_ret", "prefs_num_prefs_poss", "prefs_num_prefs_ful", "prefs_num_prefs_ful_ret")
_TIDY = ["measure", "qid", "value", "text"]


def per_query_values(run: DataFrame, qrels: DataFrame, cfg: EvalConfig, wanted: list[M.Wanted]) -> DataFrame:
    """``keys, measure, avg, value, text``: one row per query (or query and judgment group) and measure."""
    keys = list(cfg.keys)
    rows = judge(run, qrels, cfg)
    sets: dict[tuple, str] = {}
    gains_of = lambda w: w.params if w.measure.kind == "gains" else ()
    for w in wanted:
        if w.measure.name in M.GAIN_MEASURES:
            sets.setdefault(gains_of(w), str(len(sets)))
    cutoffs = sorted({k for w in wanted if w.measure.name == "ndcg_cut" for k in w.params})
    needs_running = {gains_of(w) for w in wanted if w.measure.name in M.RUNNING_GAINS}
    largest = largest_group(run, ["qid"]) if needs_running else 0
    for gains, tag in sets.items():
        rows = rows.join(ideal_stats(qrels, cfg, dict(gains), cutoffs, f"ideal_{tag}"), keys, "left")
        g, r = gain_of(F.col("rel"), dict(gains)), F.col("r")
        levels = F.col(f"ideal_{tag}.levels")
        ideal = F.coalesce(F.get(F.filter(levels, lambda x: x["m"] >= F.col("r")), F.lit(0))["gain"], F.lit(0.0))
        rows = rows.withColumn(f"g_{tag}", g)
        if gains in needs_running:
            rows = running(rows.withColumn(f"ig_{tag}", ideal), keys, [r.asc()], {
                f"dcg_{tag}": F.col(f"g_{tag}") / F.log2(r + 1), f"idcg_{tag}": F.col(f"ig_{tag}") / F.log2(r + 1),
                f"gain_{tag}": F.col(f"g_{tag}"), f"cost_{tag}": F.greatest(F.col(f"ig_{tag}"), F.lit(1.0)),
            }, largest)
    built: list[tuple[str, str, Column]] = []
    for w in wanted:
        if w.measure.name == "utility":
            made = w.measure.build(w, cfg.collection_size)
        elif w.measure.name in M.GAIN_MEASURES:
            made = w.measure.build(w, sets[gains_of(w)])
        else:
            made = w.measure.build(w)
        built += [(label, w.measure.avg, col) for label, col in made]
    agg = rows.groupBy(*keys).agg(F.lit(1).alias("_some"), *[col.alias(f"v{i}") for i, (_, _, col) in enumerate(built)])
    # A query whose documents were all dropped still counts, with nothing retrieved.
    base = judgment_stats(qrels, cfg).join(run.select("qid").distinct(), "qid", "left_semi")
    wide = base.join(agg, keys, "left")
    # Written as one text: thousands of calls to the JVM would take longer than the query.
    entries = []
    for i, (label, avg, _) in enumerate(built):
        v, empty = "n_rel" if label == "num_rel" else f"v{i}", math.log(M.GEO_FLOOR) if avg == "geo" else 0.0
        kinds = (f"CAST(NULL AS DOUBLE) AS value, coalesce({v}, '\\'\\'') AS text" if label.split("_")[0] == "relstring" else f"coalesce(CAST({v} AS DOUBLE), {empty!r}D) AS value, CAST(NULL AS STRING) AS text")
        entries.append(f"struct('{label}' AS measure, '{avg}' AS avg, {kinds})")
    return wide.select(*keys, F.expr(f"inline(array({', '.join(entries)}))"))


def zscore_values(values: DataFrame, zscores: DataFrame) -> DataFrame:
    """Values as (value - mean) / stddev of the query and measure; MISSING_Z without a reference, or with a stddev of
    0 unless the value is the mean (then 0)."""
    z = F.when(F.col("stddev").isNull(), MISSING_Z).when(F.col("stddev") == 0, F.when(F.col("value") == F.col("mean"), 0.0).otherwise(MISSING_Z))
    z = z.otherwise(F.try_divide(F.col("value") - F.col("mean"), F.col("stddev")))
    return values.join(zscores, ["qid", "measure"], "left").withColumn("value", F.when(F.col("text").isNull(), z)).drop("mean", "stddev")


def summary_values(values: DataFrame, judged: DataFrame, cfg: EvalConfig) -> DataFrame:
    """One row per measure over all queries; with cfg.complete over all judged queries, those without documents
    counting as 0 (for geometric means as their floor). ``judged`` is the result of judgment_stats()."""
    n_q = values.select("qid").distinct().agg(F.count(F.lit(1)).alias("n_ret"))
    n_all = judged.select("qid").distinct().agg(F.count(F.lit(1)).alias("n_all"))
    s = values.where("avg != 'none' and measure is not null").groupBy("measure", "avg").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    sizes = n_q.join(n_all).join(judged.agg(F.sum("n_pos").cast("double").alias("r0")))  # one row each
    s = s.join(F.broadcast(sizes))
    n = F.col("n_all") if cfg.complete else F.col("n")
    geo = F.exp((F.col("s") + (n - F.col("n")) * F.log(F.lit(M.GEO_FLOOR))) / n)
    total = F.when(F.lit(cfg.complete) & (F.col("measure") == "num_rel"), F.col("r0")).otherwise(F.col("s"))
    value = F.when(F.col("avg") == "sum", total).when(F.col("avg") == "geo", geo).otherwise(F.col("s") / n)
    return s.select("measure", F.lit("all").alias("qid"), value.alias("value"), F.lit(None).cast("string").alias("text"))


def _whole_run(run: DataFrame, values: DataFrame, judged: DataFrame, cfg: EvalConfig, names: set[str]) -> list[DataFrame]:
    out = []
    if "runid" in names and "run_id" in run.columns:
        last = F.max_by("run_id", "line_no") if "line_no" in run.columns else F.max("run_id")
        out.append(run.agg(last.alias("text")).select(F.lit("runid").alias("measure"), F.lit("all").alias("qid"), F.lit(None).cast("double").alias("value"), "text"))
    if "num_q" in names:
        of = judged if cfg.complete else values
        out.append(of.select("qid").distinct().agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("num_q").alias("measure"), F.lit("all").alias("qid"), "value", F.lit(None).cast("string").alias("text")))
    return out


def evaluate(run: DataFrame, qrels: DataFrame, cfg: EvalConfig | None = None, zscores: DataFrame | None = None) -> DataFrame:
    """``measure, qid, value, text`` of a run (qid, docno, sim, ...) against judgments (qid, docno, rel; for measures
    over judgment groups also jg; for preference measures qid, jg, jsg, docno, level).

    Rows with qid 'all' hold the summary; text holds what isn't a number. With zscores the values are scores of the
    values, and Z stands before the names of what is a number. Queries in only one of the two inputs are
    ignored, unless cfg.complete. No query in common is an error. Run and judgments are read once, and the values of the
    queries are computed once.
    """
    from rankspark.operators.prefs import preference_values

    cfg = cfg or EvalConfig()
    wanted = M.parse_measures(cfg.measures)
    names = {w.measure.name for w in wanted}
    if cfg.only_query is not None:
        run, qrels = run.where(F.col("qid") == cfg.only_query), qrels.where(F.col("qid") == cfg.only_query)
    run = materialise(run.select(*[c for c in ("qid", "docno", "sim", "run_id", "line_no") if c in run.columns]))
    qrels = materialise(qrels.select(*[c for c in ("qid", "jg", "jsg", "docno", "rel", "level") if c in qrels.columns]))
    if run.select("qid").join(qrels.select("qid").distinct(), "qid", "left_semi").isEmpty():
        raise ValueError("run and judgments have no query in common")
    plain = [w for w in wanted if not w.measure.name.startswith("prefs_") and not w.measure.name.endswith("_avgjg") and w.measure.name not in ("runid", "num_q")]
    grouped = [w for w in wanted if w.measure.name.endswith("_avgjg") and not w.measure.name.startswith("prefs_")]
    prefs = [w for w in wanted if w.measure.name.startswith("prefs_")]
    parts = []
    if plain:
        parts.append(per_query_values(run, qrels, replace(cfg, keys=("qid",)), plain))
    if grouped:
        by = per_query_values(run, qrels, replace(cfg, keys=("qid", "jg")), grouped)
        parts.append(by.groupBy("qid", "measure", "avg").agg(F.avg("value").alias("value"), F.lit(None).cast("string").alias("text")))
    if prefs:
        parts.append(preference_values(run, qrels, cfg, [w.measure.name for w in prefs]))
    if not parts:  # only what is said of the whole run
        parts.append(per_query_values(run, qrels, replace(cfg, keys=("qid",)), M.parse_measures(["num_ret"])).withColumn("measure", F.lit(None).cast("string")))
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p.select(*values.columns))
    values = materialise(values)
    if "rel" in qrels.columns:
        judged = judgment_stats(qrels, replace(cfg, keys=("qid",)))
    else:
        judged = qrels.select("qid").distinct().withColumn("n_pos", F.lit(0))
    if zscores is not None:
        values = zscore_values(values, zscores)
    out = []
    if cfg.per_query:
        out.append(values.where("avg != 'geo' and measure is not null").select(*_TIDY))
    if cfg.summary:
        out += [*_whole_run(run, values, judged, cfg, names), summary_values(values, judged, cfg)]
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    if zscores is not None:
        result = result.withColumn("measure", F.when(F.col("text").isNull(), F.concat(F.lit("Z"), F.col("measure"))).otherwise(F.col("measure")))
    return result


def report_lines(tidy: DataFrame) -> DataFrame:
    """``value``: printed lines ``measure(22) TAB qid TAB value`` with 4 decimals, counts without."""
    number = F.when(F.col("measure").isin(*COUNTS), F.format_string("%d", F.col("value").cast("long"))).otherwise(F.replace(F.format_string("%6.4f", F.col("value")), F.lit("NaN"), F.lit("nan")))
    name = F.regexp_replace("measure", "^Z", "")  # no measure's own name starts with Z
    padded = F.concat(F.when(F.startswith("measure", F.lit("Z")), "Z").otherwise(""), F.rpad(name, F.greatest(F.lit(22), F.length(name)), " "))
    return tidy.select(F.concat(padded, F.lit("\t"), F.col("qid"), F.lit("\t"), F.coalesce("text", number)).alias("value"))


def correct_counts(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """``qid, correct``: retrieved documents judged relevant (rel > 0), of every judged query."""
    good = qrels.where("rel > 0").select("qid", "docno").distinct()
    hit = results.select("qid", "docno").distinct().join(good, ["qid", "docno"]).groupBy("qid").agg(F.count(F.lit(1)).alias("correct"))
    return qrels.select("qid").distinct().join(hit, "qid", "left").na.fill(0, ["correct"])


def mean_f1(results: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """``qid, f1``: per query the mean of F1 at the cutoffs; results carry their rank."""
    good = qrels.where("rel > 0").select("qid", "docno").distinct().withColumn("hit", F.lit(1))
    size = good.groupBy("qid").agg(F.count(F.lit(1)).alias("R"))
    j = results.select("qid", "docno", "rank").join(good, ["qid", "docno"], "left")
    found = [F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("hit"))), F.lit(0)).alias(f"h{k}") for k in cutoffs]
    got = j.groupBy("qid").agg(*found).join(size, "qid")
    f1 = [F.lit(2.0) * F.col(f"h{k}") / (F.lit(k) + F.col("R")) for k in cutoffs]  # 2PR/(P+R)
    return got.select("qid", (sum(f1, F.lit(0.0)) / len(cutoffs)).alias("f1"))


def mean_ndcg(results: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 50)) -> DataFrame:
    """``qid, ndcg_<k>...``: linear gain over log2(rank + 1), by the results' own rank; the ideal is all gold sorted."""
    j = results.select("qid", "docno", "rank").join(gold.select("qid", "docno", "rel"), ["qid", "docno"], "left")
    d = lambda g, i: F.coalesce(g, F.lit(0)) / F.log2(i + 1)
    got = j.groupBy("qid").agg(*[F.sum(F.when(F.col("rank") <= k, d(F.col("rel"), F.col("rank")))).alias(f"d{k}") for k in cutoffs])
    i = running(gold.select("qid", "docno", "rel"), ["qid"], [F.desc("rel"), F.asc("docno")], {"i": F.lit(1)}, largest_group(gold, ["qid"]))
    best = i.groupBy("qid").agg(*[F.sum(F.when(F.col("i") <= k, d(F.col("rel"), F.col("i")))).alias(f"i{k}") for k in cutoffs])
    return got.join(best, "qid").select("qid", *[F.coalesce(F.try_divide(F.coalesce(f"d{k}", F.lit(0.0)), F.col(f"i{k}")), F.lit(0.0)).alias(f"ndcg_{k}") for k in cutoffs])


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, n``: equal-width counts between the least and the greatest value; the last bin holds the greatest."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint")
    b = F.lit(0) if hi == lo else F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
