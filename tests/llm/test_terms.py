import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rankspark.llm import distinctive, termstats

TOKEN = re.compile(r"""[^ \t\n\r\x0b\f.:;"'?!,~`()/#*%+\-\[\]{}@^]+""")
SCHEMA = "docid string, title string, content string, loaded_at timestamp, term string"


def _lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s or "")


@pytest.fixture(scope="module")
def docs(spark):
    import datetime

    rnd = random.Random(5)
    words = ["The", "the", "Ärzte", "x_1", "a&b", "don't", "e.g.", "[z]", "tab\tbed", "line\r\nend", "rare"] + [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        t = " ".join(rnd.choices(words, k=rnd.randint(0, 60)))
        rows.append((f"d{i}", rnd.choice([None, "", "Title the", " \n"]), rnd.choice([t, t, t, None]), datetime.datetime(2022, 1, 1), "clash"))
    rows += [(f"d{i}", *rows[i][1:3], datetime.datetime(2022, 2, 1), "clash") for i in range(10)]
    rows += [(None, "no key", "no key", None, "clash"), ("long", None, "big " * 50_000, None, "clash")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_term_frequencies(docs):
    rows, df = docs
    recs = {r[0]: r for r in rows if r[0] is not None}
    occ, dfs = collections.Counter(), collections.Counter()
    for r in recs.values():
        t = TOKEN.findall(_lower(r[1]) + "\n" + _lower(r[2]))
        occ.update(t)
        dfs.update(set(t))
    got = {r.term: (r.occurrences, r.records, r.mark) for r in termstats.term_frequencies(df).collect()}
    n = len(recs)
    assert got == {t: (occ[t], dfs[t], "rare" if dfs[t] < 3 else "common" if dfs[t] > n / 4 else None) for t in occ}


def test_dictionary_numbers_without_gaps(docs):
    _, df = docs
    d = termstats.dictionary(df.select(F.explode(F.split(F.coalesce("content", F.lit("")), " ")).alias("term")))
    ids = sorted(r.term_id for r in d.collect())
    assert ids == list(range(len(ids)))


def test_empty_tables(docs):
    _, df = docs
    assert termstats.term_frequencies(df.limit(0)).count() == 0
    assert distinctive.distinctive_terms(df.limit(0)).count() == 0


def test_distinctive_terms(docs):
    rows, df = docs
    recs = {r[0]: r for r in rows if r[0] is not None}
    tf = {(k, t): n for k, r in recs.items() for t, n in collections.Counter(TOKEN.findall(_lower(r[2]))).items()}
    dfs = collections.Counter(t for _, t in tf)
    got = distinctive.distinctive_terms(df).collect()
    assert {(r.docid, r.term): (r.tf, r.records) for r in got} == {k: (n, dfs[k[1]]) for k, n in tf.items()}
    assert all(0 <= r.posterior <= 1 and r.score >= 0 for r in got)
    of = {(r.docid, r.term): r.score for r in got}
    assert of["long", "big"] > max(s for (_, t), s in of.items() if t == "the")


def test_two_poisson_fit_recovers_a_mixture():
    rng = np.random.default_rng(1)
    elite = rng.random(20000) < 0.2
    x = np.where(elite, rng.poisson(6.0, 20000), rng.poisson(0.3, 20000))
    tf, n = np.unique(x[x > 0], return_counts=True)
    p, high, low = distinctive.fit_two_poisson(np.concatenate([tf, [1]]), np.concatenate([n, [5]]), np.array([0, len(tf)]), 20000)
    assert p[0] == pytest.approx(0.2, abs=0.02) and high[0] == pytest.approx(6, abs=0.3) and low[0] == pytest.approx(0.3, abs=0.05)
    alone = distinctive.fit_two_poisson(tf, n, np.array([0]), 20000)
    assert alone[0][0] == p[0]  # a fit doesn't depend on its neighbours


@given(st.lists(st.integers(1, 12), min_size=1, max_size=5), st.integers(4, 300), st.sampled_from([2, 6, 10, 30, 60, 635, 63500, 10**9]))
@settings(max_examples=400, deadline=None)
def test_no_rare_and_repeated_term_is_below_the_least_score(rest, most, n_records):
    counts = [most, *[min(x, most) for x in rest]]
    if len(counts) > n_records:
        return
    tf, n = np.unique(counts, return_counts=True)
    best = distinctive.best_scores(np.array([most]), *distinctive.fit_two_poisson(tf, n, np.array([0]), n_records))
    assert best[0] >= distinctive.least_score(n_records, 4, 6) - 1e-9


def test_rare_and_repeated_terms_come_from_the_scores(docs, monkeypatch):
    rows, df = docs
    recs = {r[0]: r for r in rows if r[0] is not None}
    tf = {(k, t): n for k, r in recs.items() for t, n in collections.Counter(TOKEN.findall(_lower(r[2]))).items()}
    dfs = collections.Counter(t for _, t in tf)
    want = {k for k, n in tf.items() if n >= 2 and 2 <= dfs[k[1]] <= 20}
    got = lambda: {(r.docid, r.term) for r in distinctive.rare_and_repeated(df, 2, 2, 20).collect()}
    assert got() == want and want
    monkeypatch.setattr(distinctive, "least_score", lambda *a: 1e6)
    assert got() == set()
