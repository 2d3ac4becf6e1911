import datetime
import random

import numpy as np
import pytest

from rankspark.llm import fuse

STAND = ["n/a", "untitled"]
META = "row_id long, cord_uid string, title string, abstract string, pmc_json_files string, source_x string, updated_at timestamp, value string"


@pytest.fixture(scope="module")
def trust(spark):
    return spark.createDataFrame([("Pub", 9), ("mid", 4), ("mirror", 4), ("none", None), (None, 3)], "source_x string, trust int")


def _rows(n):
    rnd = random.Random(n)
    day = lambda: rnd.choice([None, datetime.datetime(2022, 1, rnd.randint(1, 3))])
    keys = ["k1", " K1\t", "k2", "k3", "hot", "hot", "hot", "", None, " "]
    return [
        (i, rnd.choice(keys), rnd.choice(["Title A", " Title A ", "Title B", None, "", "N/A"]), rnd.choice([None, "abs", "untitled "]), rnd.choice(["a.json", "[]", ";", "n/a", None, '"a;b"; c']), rnd.choice(["pub", "PUB ", "mid", "mirror", "odd", "other", None, ""]), day(), "clash")
        for i in range(n)
    ]


def test_strict_prior_against_brute_force(spark, trust):
    rows = _rows(300)
    fused, learnt = fuse.fuse_records(spark.createDataFrame(rows, META).repartition(5), trust, STAND)
    got = {(r.cord_uid, r.field_name): (r.row_id, r.n_rows) for r in fused.collect()}
    groups = {}
    for r in rows:
        if r[1] and r[1].strip():
            groups.setdefault(r[1].strip().lower(), []).append(r)
    has = {"title": lambda r: r[2] is not None and r[2].strip().lower() not in ("", *STAND), "abstract": lambda r: r[3] is not None and r[3].strip().lower() not in ("", *STAND), "pmc_json_files": lambda r: r[4] in ("a.json", '"a;b"; c')}
    t = {"pub": 9, "mid": 4, "mirror": 4}
    rank = lambda r: (t.get((r[5] or "").strip().lower(), -1), r[6] or datetime.datetime.min, -r[0])
    want = {(k, f): (max(filter(ok, g), key=rank)[0], len(g)) for k, g in groups.items() for f, ok in has.items() if any(map(ok, g))}
    assert got == want
    assert all(r.posterior is not None and 0 <= r.posterior <= 1 and r.best_row_id is not None for r in fused.collect())
    assert sorted(learnt["sources"]) == sorted(["pub", "mid", "mirror", "odd", "other", fuse.POOLED, fuse.NONE])
    wide = {r.cord_uid: r.title for r in fuse.surviving_values(spark.createDataFrame(rows, META), fused).collect()}
    assert wide["hot"] == next(r[2] for r in rows if r[0] == want["hot", "title"][0])


def test_empty_table(spark, trust):
    fused, _ = fuse.fuse_records(spark.createDataFrame([], META), trust, STAND)
    assert fused.count() == 0


def test_votes_beat_a_single_source_and_copies_count_less():
    acc = np.full(4, 0.8)
    one, two = np.array([1.0, 0, 0, 0]), np.array([0, 1.0, 1.0, 0])
    free = fuse.vote_scores(np.array([one, two, one / 2]), acc, np.zeros((4, 4)))
    assert free[1] == pytest.approx(2 * free[0]) and free[2] == pytest.approx(free[0] / 2)
    dep = np.zeros((4, 4))
    dep[1, 2] = dep[2, 1] = 1.0
    assert fuse.vote_scores(np.array([two]), acc, dep)[0] == pytest.approx((2 - fuse.COPY_RATE) * free[0])


def test_all_claims_of_all_sources_vote(spark, trust, monkeypatch):
    """Sources outside the register and later rows of a source count; where sources are too many the rest is one."""
    rows = [(1, "k", "right", None, None, "s1", None, "x"), (2, "k", " RIGHT ", None, None, "s2", None, "x"), (3, "k", "Wrong", None, None, "pub", None, "x")]
    rows += [(4, "k2", "a", None, None, "s1", None, "x"), (5, "k2", "b", None, None, "s1", None, "x"), (6, "k2", "b", None, None, "s1", None, "x")]
    df = spark.createDataFrame(rows, META)
    fused, learnt = fuse.fuse_records(df, trust, STAND)
    got = {r.cord_uid: r for r in fused.collect()}
    assert (got["k"].row_id, got["k"].best_row_id, got["k"].n_sources, got["k"].n_values) == (3, 1, 3, 2)
    assert (got["k2"].row_id, got["k2"].best_row_id, got["k2"].n_sources, got["k2"].n_values) == (4, 5, 1, 2)
    assert got["k"].best_posterior > 0.9 > 0.1 > got["k"].posterior
    monkeypatch.setattr(fuse, "MAX_SOURCES", 3)
    fused, learnt = fuse.fuse_records(df, trust, STAND)
    assert learnt["sources"] == ["s1", fuse.POOLED, fuse.NONE]
    assert {r.cord_uid: (r.row_id, r.n_values) for r in fused.collect()} == {"k": (3, 2), "k2": (4, 2)}


def test_a_hot_group_of_many_values(spark, trust):
    rows = [(i, "hot", f"title {i % 7000}", None, None, ["pub", "mid", None][i % 3], None, "x") for i in range(20_000)]
    fused, _ = fuse.fuse_records(spark.createDataFrame(rows, META), trust, STAND)
    assert [(r.n_rows, r.n_sources, r.n_values, r.row_id) for r in fused.collect()] == [(20_000, 3, 7000, 0)]


def test_shared_false_values_show_dependence():
    acc = np.array([0.8, 0.8, 0.8])
    zero = np.zeros((3, 3))
    true, false, diff = zero + 50, zero.copy(), zero + 10
    false[0, 1] = false[1, 0] = 15
    dep = fuse.dependence(true, false, diff, acc)
    assert dep[0, 1] > 0.9 and dep[0, 2] < 0.1


def test_mirror_is_found(spark, trust):
    rnd = random.Random(2)
    rows, i = [], 0
    for k in range(400):
        claim = {s: "right" if rnd.random() < 0.8 else f"wrong {rnd.randint(0, 9)}" for s in ("pub", "mid", "odd")}
        claim["mirror"] = claim["mid"] if rnd.random() < 0.95 else "right"
        for s, v in claim.items():
            i += 1
            rows.append((i, f"k{k}", v, None, None, s, None, "x"))
    fused, learnt = fuse.fuse_records(spark.createDataFrame(rows, META), trust, STAND)
    at = {s: j for j, s in enumerate(learnt["sources"])}
    assert learnt["dependence"][at["mid"], at["mirror"]] > 0.9 > 0.5 > learnt["dependence"][at["mid"], at["pub"]]
    picked = {r.cord_uid: r.best_row_id for r in fused.collect()}
    title = {r[0]: r[2] for r in rows}
    assert sum(title[x] == "right" for x in picked.values()) > 340


def test_many_sources_give_what_few_give(spark, trust, monkeypatch):
    """Sources beyond the arrays keep their own votes, accuracies and dependences: the same numbers from tables."""
    rnd = random.Random(5)
    rows, i = [], 0
    for k in range(60):
        for s in ("pub", "mid", "mirror", "odd", "rare", None):
            for _ in range(rnd.choice([0, 1, 1, 2] if s != "rare" else [0, 0, 1])):
                i += 1
                rows.append((i, f"k{k}", rnd.choice(["right", "right", "right", f"wrong {rnd.randint(0, 2)}"]), rnd.choice([None, "abs", "other"]), None, s, None, "x"))
    df = spark.createDataFrame(rows, META).repartition(3)

    def run():
        fused, learnt = fuse.fuse_records(df, trust, STAND)
        return {(r.cord_uid, r.field_name): r for r in fused.collect()}, {r.source: r for r in fuse.source_report(spark, learnt).collect()}

    few, few_sources = run()
    monkeypatch.setattr(fuse, "MAX_SOURCES", 4)
    many, many_sources = run()
    assert few.keys() == many.keys() and few_sources.keys() == many_sources.keys()
    for k, r in few.items():
        assert many[k][:6] == r[:6] and many[k].best_row_id == r.best_row_id
        assert (many[k].posterior, many[k].best_posterior) == pytest.approx((r.posterior, r.best_posterior), abs=1e-9)
    for s, r in few_sources.items():
        assert many_sources[s].copies_of == r.copies_of
        assert (many_sources[s].accuracy, many_sources[s].dependence) == pytest.approx((r.accuracy, r.dependence), abs=1e-9)


def test_hundreds_of_sources_have_a_vote_each(spark, trust):
    names = [f"s{j:03}" for j in range(210)]
    claim = [("k", "right", s) for s in names[2:]] + [("k", "wrong", s) for s in names[:2]]
    claim += [("k2", "right", s) for s in names[-5:]] + [("k2", "wrong", s) for s in names[:2]]
    claim += [(f"alone {s}", "x", s) for s in names[:120] for _ in range(2)]
    rows = [(i, k, v, None, None, s, None, "x") for i, (k, v, s) in enumerate(claim)]
    fused, learnt = fuse.fuse_records(spark.createDataFrame(rows, META), trust, STAND)
    got = {r.cord_uid: r for r in fused.collect()}
    assert (got["k"].n_sources, got["k2"].n_sources) == (210, 7)
    assert claim[got["k"].best_row_id][1] == claim[got["k2"].best_row_id][1] == "right"
    assert all(0 <= r.best_posterior <= 1 for r in got.values())
    assert {r.source for r in fuse.source_report(spark, learnt).collect()} == {*names, fuse.POOLED, fuse.NONE}
