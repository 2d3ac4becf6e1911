"""Preference measures: how many of the judged preferences a ranking fulfils.

Judged documents of a query get a position: the retrieved ones by rank, then the others by name. A preference is a
pair of documents of one judgment group; with a single subgroup the pairs are those of different levels, with several
they are the transitive closure of the subgroups' preferences, found by joining new pairs with the given ones until
nothing is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rankspark.operators.judge import EvalConfig, rank_run, unique
from rankspark.operators.pairs import dealt
from rankspark.operators.positions import largest_group, running
from rankspark.plans.stage import materialise

_JG = ["qid", "jg"]


def positions(run: DataFrame, prefs: DataFrame, max_docs: int) -> DataFrame:
    """``qid, docno, pos, ret``: places of the judged documents of retrieved queries, from 1."""
    ranked = rank_run(run, max_docs, docno_desc=False)
    docs = prefs.select("qid", "docno").distinct().join(ranked.select("qid").distinct(), "qid", "left_semi")
    held = docs.join(ranked.select("qid", "docno", "rank"), ["qid", "docno"], "left")
    placed = running(held, ["qid"], [F.col("rank").asc_nulls_last(), F.col("docno").asc()], {"pos": F.lit(1)}, largest_group(prefs, ["qid"]))
    return placed.select("qid", "docno", "pos", F.col("rank").isNotNull().alias("ret"))


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Transitive closure of ``qid, jg, a, b`` (a preferred to b). A cycle fails the query, as do chains of more than
    2^max_rounds preferences (a round doubles what is reached)."""
    keys = [*_JG, "a", "b"]
    known = materialise(edges.select(*keys).distinct())
    size = known.count()
    for _ in range(max_rounds):
        step = known.alias("x").join(known.select(*_JG, F.col("a").alias("b"), F.col("b").alias("z")), [*_JG, "b"]).select(*_JG, "a", F.col("z").alias("b")).distinct()
        grown = materialise(known.select(*keys).distinct().unionByName(step).distinct())
        if grown.count() == size:
            break
        known, size = grown, grown.count()
    else:
        raise ValueError(f"the preferences are not closed after {max_rounds} rounds")
    if not known.where(F.col("a") == F.col("b")).isEmpty():
        raise ValueError("preferences contradict each other")
    return known


def preference_pairs(prefs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs ``qid, jg, a, b`` with a preferred to b, and per group whether it has several subgroups."""
    kinds = prefs.groupBy(*_JG).agg((F.countDistinct("jsg") > 1).alias("matrix"))
    p = unique(prefs.select(*_JG, "jsg", "docno", "level"), [*_JG, "jsg", "docno"], "preferences").withColumnRenamed("docno", "a")
    b = p.select(*_JG, "jsg", F.col("a").alias("b"), F.col("level").alias("lb"))
    left, right, on = dealt(p, b, [*_JG, "jsg"], "a")
    edges = left.join(right, on).where("level > lb").select(*_JG, "a", "b").join(kinds, _JG)
    plain = edges.where("not matrix").select(*_JG, "a", "b")
    return plain.unionByName(closure(edges.where("matrix"))), kinds


def preference_values(run: DataFrame, prefs: DataFrame, cfg: EvalConfig, names: list[str]) -> DataFrame:
    """``qid, measure, avg, value, text`` of the preference measures asked for."""
    prefs = materialise(prefs.join(run.select("qid").distinct(), "qid", "left_semi"))
    pos = materialise(positions(run, prefs, cfg.max_docs))
    pairs, kinds = preference_pairs(prefs)
    at = lambda s: pos.select("qid", F.col("docno").alias(s), F.col("pos").alias(f"p{s}"), F.col("ret").alias(f"r{s}"))
    placed = materialise(pairs.join(at("a"), ["qid", "a"]).join(at("b"), ["qid", "b"]).withColumns({
        "both": F.col("ra") & F.col("rb"), "one": F.col("ra") != F.col("rb"), "ful": (F.col("pa") < F.col("pb")) & (F.col("ra") | F.col("rb")),
    }))
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    both, some, ful = F.col("both"), F.col("both") | F.col("one"), F.col("ful")
    counts = placed.groupBy(*_JG).agg(n(F.lit(True)).alias("poss"), n(ful).alias("fulfilled"), n(both).alias("poss_ret"), n(both & ful).alias("ful_ret"), n(some).alias("poss_imp"))
    jgs = kinds.join(counts, _JG, "left").na.fill(0).join(_group_sizes(prefs, pos, kinds), _JG, "left")
    jgs = materialise(jgs.join(_recounts(prefs, pos, placed, jgs), _JG, "left"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    c = F.col
    enough, enough_ret = c("rel") >= c("nonrel"), c("rel_ret") >= c("nonrel_ret")
    more, more_ret = c("rel") - c("nonrel"), c("rel_ret") - c("nonrel_ret")
    full = F.when(enough, ratio(c("fulfilled") + c("rel_ret") * more, c("poss") + c("rel") * more)).otherwise(ratio(c("re_ful"), c("re_poss")))
    ret = F.when(enough_ret, ratio(c("ful_ret") + c("rel_ret") * more_ret, c("poss_ret") + c("rel") * more_ret)).otherwise(ratio(c("re_ful_ret"), c("re_poss_ret")))
    s = F.sum
    of_jgs = jgs.groupBy("qid").agg(
        s("poss").alias("prefs_num_prefs_poss"), s("fulfilled").alias("prefs_num_prefs_ful"), s("ful_ret").alias("prefs_num_prefs_ful_ret"),
        ratio(s("fulfilled"), s("poss")).alias("prefs_simp"), ratio(s("ful_ret"), s("poss_ret")).alias("prefs_simp_ret"), ratio(s("fulfilled"), s("poss_imp")).alias("prefs_simp_imp"),
        F.avg(ratio(c("fulfilled"), c("poss"))).alias("prefs_avgjg"), F.avg(ratio(c("ful_ret"), c("poss_ret"))).alias("prefs_avgjg_ret"),
        F.avg(ratio(c("fulfilled"), c("poss_imp"))).alias("prefs_avgjg_imp"), F.avg(full).alias("prefs_avgjg_Rnonrel"), F.avg(ret).alias("prefs_avgjg_Rnonrel_ret"),
    )
    # Over the judgment groups: of each two documents, how often the better placed one is the preferred one.
    two = placed.groupBy("qid", F.least("pa", "pb").alias("p1"), F.greatest("pa", "pb").alias("p2"), "both", "one").agg(F.avg((c("pa") < c("pb")).cast("double")).alias("good"))
    of_pairs = two.groupBy("qid").agg(
        ratio(F.sum(F.when(some, c("good"))), F.count(F.lit(1))).alias("prefs_pair"), ratio(F.sum(F.when(both, c("good"))), n(both)).alias("prefs_pair_ret"),
        ratio(F.sum(F.when(some, c("good"))), n(some)).alias("prefs_pair_imp"),
    )
    wide = of_jgs.join(of_pairs, "qid", "left")
    e = [F.struct(F.lit(m).alias("measure"), F.lit("sum" if "num_prefs" in m else "mean").alias("avg"), F.coalesce(c(m).cast("double"), F.lit(0.0)).alias("value"), F.lit(None).cast("string").alias("text")) for m in names]
    return wide.select("qid", F.explode(F.array(*e)).alias("m")).select("qid", "m.*")


def _placed_docs(prefs: DataFrame, pos: DataFrame) -> DataFrame:
    """One row per group and document with its greatest level and its position."""
    return prefs.groupBy(*_JG, "docno").agg(F.max("level").alias("level")).join(pos, ["qid", "docno"])


def _group_sizes(prefs: DataFrame, pos: DataFrame, kinds: DataFrame) -> DataFrame:
    """Relevant and nonrelevant documents per group: a level of 0 or less is nonrelevant, with several subgroups only 0."""
    d = _placed_docs(prefs, pos).join(kinds, _JG)
    rel, non = F.col("level") > 0, F.when(F.col("matrix"), F.col("level") == 0).otherwise(F.col("level") <= 0)
    n = lambda cond: F.sum(cond.cast("long"))
    return d.groupBy(*_JG).agg(n(rel).alias("rel"), n(non).alias("nonrel"), n(rel & F.col("ret")).alias("rel_ret"), n(non & F.col("ret")).alias("nonrel_ret"))


def _recounts(prefs: DataFrame, pos: DataFrame, placed: DataFrame, jgs: DataFrame) -> DataFrame:
    """Counts with only the first nonrelevant documents kept, for groups with more nonrelevant than relevant ones.

    With a single subgroup the last level's first documents (as many as there are relevant ones) are compared with all
    documents of the group, those of their own level included; with several, pairs with a dropped document are left out.
    """
    d = _placed_docs(prefs, pos).join(jgs.select(*_JG, "matrix", "rel", "rel_ret"), _JG)
    w = Window.partitionBy(*_JG)
    d = materialise(d.withColumns({"last": F.col("level") == F.min("level").over(w), "none": F.col("level") == 0}).withColumns({
        "k_last": F.row_number().over(Window.partitionBy(*_JG, "last").orderBy("pos")), "k_none": F.row_number().over(Window.partitionBy(*_JG, "none").orderBy("pos")),
    }))
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    out = []
    for suffix, size in (("", "rel"), ("_ret", "rel_ret")):
        kept = d.where(f"last and not matrix and k_last <= {size}").select(*_JG, F.col("docno").alias("b"), F.col("pos").alias("pb"), F.col("ret").alias("rb"))
        a = d.where("not matrix").select(*_JG, F.col("docno").alias("a"), F.col("pos").alias("pa"), F.col("ret").alias("ra"))
        lasts = d.where("last and not matrix").select(*_JG, F.col("docno").alias("b"))
        upper = placed.join(d.select(*_JG).where("not matrix").distinct(), _JG, "left_semi").join(lasts, [*_JG, "b"], "left_anti").select(*_JG, "a", "pa", "ra", "b", "pb", "rb")
        flat = upper.unionByName(a.join(kept, _JG).select(*_JG, "a", "pa", "ra", "b", "pb", "rb"))
        gone = d.where("matrix and none and k_none > rel").select(*_JG, F.col("docno").alias("x"))
        m = placed.join(d.where("matrix").select(*_JG).distinct(), _JG, "left_semi")
        for s in ("a", "b"):
            m = m.join(gone.withColumnRenamed("x", s), [*_JG, s], "left_anti")
        rows = flat.unionByName(m.select(*_JG, "a", "pa", "ra", "b", "pb", "rb"))
        if suffix:
            rows = rows.where("ra and rb")
        out.append(rows.groupBy(*_JG).agg(n(F.lit(True)).alias(f"re_poss{suffix}"), n((F.col("pa") < F.col("pb")) & F.col("ra")).alias(f"re_ful{suffix}")))
    return out[0].join(out[1], _JG, "full")
