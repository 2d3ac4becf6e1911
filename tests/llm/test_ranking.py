import math
import random

import pytest
from pyspark.sql import functions as F

from rankspark.llm import onerank, topn
from rankspark.operators.positions import exact_positions

RUNS = "run_id string, query_number int, docno string, rank int, score double, pos string"


def _expected(rows, n):
    best = {}
    for run, q, d, _, s, _ in rows:
        if s is not None and not math.isnan(s) and d is not None:
            g = best.setdefault((run, q), {})
            g[d] = max(g.get(d, -math.inf), s)
    return {(*k, d) for k, g in best.items() for _, d in sorted(((s, d) for d, s in g.items()), reverse=True)[:n]}


def test_top_n_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["r1", "r2", None]), rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([f"d{i}" for i in range(300)] + [None]), rnd.randint(1, 9), rnd.choice([None, math.nan, math.inf, -math.inf, 0.0, -0.0, *range(40)]), "x") for _ in range(4000)]
    rows = [(*r[:4], None if r[4] is None else float(r[4]), r[5]) for r in rows]
    df = spark.createDataFrame(rows, RUNS).repartition(7)
    got = topn.top_n(df, 10).collect()
    assert {(r.run_id, r.query_number, r.docno) for r in got} == _expected(rows, 10)
    assert len(got) == len(_expected(rows, 10))
    assert topn.top_n(df.limit(0)).count() == 0


def test_exact_positions_across_partitions(spark):
    """One group over all partitions; positions must be exact and reach across them."""
    df = spark.range(5000).select(F.lit("g").alias("k"), F.col("id").alias("v")).unionByName(spark.range(3).select(F.lit("h").alias("k"), F.col("id").alias("v"))).repartition(9)
    got = exact_positions(df, ["k"], [F.desc("v")])
    assert got.where("k = 'g' and pos != 5000 - v").count() == 0 and got.count() == 5003
    some = exact_positions(df, ["k"], [F.desc("v")], F.when(F.col("k") == "g", 1500).otherwise(2))
    assert some.groupBy("k").count().orderBy("k").collect() == [("g", 1500), ("h", 2)]


def _winners(rows):
    docs, named = {}, {}
    for q, d, ranks in rows:
        if q is None or d is None:
            continue
        g = docs.setdefault(q, {}).setdefault(d, {})
        for e, r in (ranks or {}).items():
            named.setdefault(q, set()).add(e)
            if r is not None and r >= 1:
                g[e] = min(g.get(e, 10**9), r)
    ahead = lambda a, b: sum(r < b.get(e, 10**9) for e, r in a.items())
    return {(q, d) for q, g in docs.items() if len(g) > 1 for d, a in g.items() if all(2 * ahead(a, b) > len(named.get(q, ())) for x, b in g.items() if x != d)}


@pytest.mark.parametrize("size", [12, 700])
def test_majority_winner_against_brute_force(spark, size):
    rnd = random.Random(size)
    rows = []
    for q in range(30 if size < 100 else 2):
        strong = rnd.random() < 0.6
        for d in range(rnd.randint(1, size)):
            for _ in range(rnd.choice([1, 1, 2])):
                rows.append((q, f"d{d}", {e: rnd.choice([None, 0, -3, 1 if strong and d == 1 else 7, rnd.randint(1, 50 * e)]) if not (strong and d == 1) else 1 for e in rnd.sample(range(1, 7), rnd.randint(1, 6))}))
        if strong:
            rows.append((q, "d1", dict.fromkeys(range(1, 7), 1)))
    rows += [(99, "only", {1: 1}), (98, "a", None), (98, "b", {}), (None, "x", {1: 1}), (97, None, {1: 1})]
    df = spark.createDataFrame(rows, "qid int, doc_id string, ranks map<int,int>")
    ranked = onerank.closeness(df)
    for narrow in (True, False):  # by the ranking's first document, and by the walk alone
        got = {(r.qid, r.doc_id) for r in onerank.majority_winners(ranked, narrow).collect()}
        assert got == _winners(rows) and got


def test_hot_queries_are_dealt_to_more_tasks(spark, monkeypatch):
    rnd = random.Random(7)
    df = spark.createDataFrame([(rnd.choice([1, 1, 1, 2]), f"d{rnd.randint(0, 9)}", {e: rnd.randint(0, 9) for e in range(3)}) for _ in range(400)], "qid int, doc_id string, ranks map<int,int>")
    assert onerank.splits_of(df) == 1
    whole = {(r.qid, r.doc_id): r.ranks for r in onerank.best_ranks(df, 1).collect()}
    monkeypatch.setattr(onerank, "TASK_ROWS", 50)
    assert onerank.splits_of(df) > 4
    assert {(r.qid, r.doc_id): r.ranks for r in onerank.best_ranks(df, onerank.splits_of(df)).collect()} == whole


def test_circles_leave_no_winner_and_a_winner_low_in_the_ranking_is_found(spark):
    rows = [(1, "a", {1: 1, 2: 2, 3: 3}), (1, "b", {1: 2, 2: 3, 3: 1}), (1, "c", {1: 3, 2: 1, 3: 2})]  # each is beaten by one
    rows += [(2, f"d{i}", {1: i, 2: i, 3: 500 - i}) for i in range(1, 400)] + [(2, "w", {1: 0 + 1, 2: 1, 3: 9000})]
    rows[3] = (2, "d1", {1: 2, 2: 2, 3: 499})
    df = spark.createDataFrame(rows, "qid int, doc_id string, ranks map<int,int>")
    assert [tuple(r) for r in onerank.majority_winners(onerank.closeness(df)).collect()] == [(2, "w")] and _winners(rows) == {(2, "w")}


def test_the_ranking_leads_to_the_winner(spark):
    """One step along the ranking leaves few candidates; along the reversed ranking nearly all."""
    rnd = random.Random(4)
    rows = [(1, f"d{i}", {e: rnd.randint(1, 10) * 10**e + i * 10**e for e in range(1, 6)}) for i in range(300)]
    ranked = onerank.closeness(spark.createDataFrame(rows, "qid int, doc_id string, ranks map<int,int>"))
    assert onerank.narrowed(ranked).count() <= 30 < 250 < onerank.narrowed(ranked.withColumn("closeness", -F.col("closeness"))).count()


def test_closeness_is_not_dominated_by_long_scales(spark):
    rows = [(1, "a", {1: 1, 2: 1, 3: 3000}), (1, "b", {1: 2, 2: 2, 3: 2000}), (1, "c", {1: 3, 2: 3, 3: 1000})]
    df = spark.createDataFrame(rows, "qid int, doc_id string, ranks map<int,int>")
    c = {r.doc_id: r.closeness for r in onerank.closeness(df, tail=0.0).collect()}
    assert c["a"] > c["b"] > c["c"] and all(0 <= x <= 1 for x in c.values())
    scaled = spark.createDataFrame([(q, d, {e: (r * 100 if e == 1 else r) for e, r in m.items()}) for q, d, m in rows], df.schema)
    assert {r.doc_id: r.closeness for r in onerank.closeness(scaled, tail=0.0).collect()} == pytest.approx(c)


def test_a_missing_rank_is_the_worst(spark):
    rows = [(1, "a", {1: 1, 2: 1}), (1, "b", {1: 1}), (1, "c", {1: 2, 2: 2})]
    c = {r.doc_id: r.closeness for r in onerank.closeness(spark.createDataFrame(rows, "qid int, doc_id string, ranks map<int,int>"), tail=0.0).collect()}
    assert c["a"] == 1.0 and c["b"] < c["a"]


def test_closeness_of_empty_and_unranked(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", {5: None})], "qid int, doc_id string, ranks map<int,int>")
    assert [r.closeness for r in onerank.closeness(df).collect()] == [0.5, 0.5]
    assert onerank.majority_winners(onerank.closeness(df.limit(0))).count() == 0
