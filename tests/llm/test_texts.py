import collections
import itertools
import os
import random
import string

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rankspark.llm import mix, pack, spans

needs_vocabulary = pytest.mark.skipif(not os.path.exists(pack.TOKENIZER), reason="no vocabulary file")
DOCS = "doc_id long, text string, source string, tokens string"


# --- packing ---


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_best_fit_decreasing_and_bound(sizes):
    s = np.sort(np.array(sizes, np.int64))[::-1]
    bins = pack.best_fit_decreasing(s, 64)
    load = np.bincount(bins, weights=s) if len(s) else np.zeros(0)
    assert (load <= 64).all()
    bound = pack.lower_bound(np.bincount(s, minlength=65), 64)
    assert bound <= len(load) <= max(bound, 1) * 11 / 9 + 1 or not len(s)


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_best_subsets(sizes):
    s = np.sort(np.array(sizes, np.int64))[::-1]
    bins = pack.best_subsets(s, 64)
    assert (np.bincount(bins, weights=s) <= 64).all() and sorted(set(bins.tolist())) == list(range(len(set(bins.tolist()))))


# Sizes that best fit lays into 32 containers of 100, one more than there must be.
TIGHT = "59 59 58 57 57 57 56 55 54 53 53 53 53 52 51 51 51 49 49 47 47 47 47 46 45 45 45 45 45 44 44 44 43 43 42 42 41 40 40 39 39 39 38 38 38 38 37 36 36 35 34 34 33 32 32 32 32 31 31 28 28 28 27 27 26 26 22 22 21 20 19 18 18 18 16 16 16 15 15 15 15 15"


def test_a_full_container_is_found_where_best_fit_misses_it():
    s = np.array(TIGHT.split(), np.int64)
    bound = pack.lower_bound(np.bincount(s, minlength=101), 100)
    assert pack.best_subsets(s, 100).max() + 1 == bound < pack.best_fit_decreasing(s, 100).max() + 1


@needs_vocabulary
def test_a_partition_with_a_gap_is_packed_again_at_any_size(spark):
    df = spark.createDataFrame([(i, " ".join(["word"] * int(n))) for i, n in enumerate(TIGHT.split())], "doc_id long, text string")
    packed = pack.pack_texts(df, 100)
    rep = pack.container_report(packed, 100).first()
    assert rep.containers == rep.lower_bound == 31 and packed.where("round > 1").count() > 0


def test_lower_bound_sees_large_items():
    assert pack.lower_bound(np.bincount([40] * 5, minlength=65), 64) == 5
    assert pack.lower_bound(np.bincount([40, 24, 32, 32], minlength=65), 64) == 2


@needs_vocabulary
def test_pack_texts(spark):
    rnd = random.Random(4)
    texts = [" ".join(["word"] * rnd.choice([0, 1, 20, 70, 100, 101, 250, 999])) for _ in range(300)] + [None, "", " \n ", "x" * 300]
    df = spark.createDataFrame([(i, t, "s", "clash") for i, t in enumerate(texts)], DOCS).repartition(4)
    p = pack.pack_texts(df, 100, part_items=60)
    rows = p.collect()
    sizes = {r.doc_id: r.tokens for r in pack.token_counts(df).collect()}
    assert {i: sum(r.tokens for r in g) for i, g in itertools.groupby(sorted(rows, key=lambda r: r.doc_id), lambda r: r.doc_id)} == {i: n for i, n in sizes.items() if n}
    load, seen = {}, set()
    for r in rows:
        load[r.round, r.part, r.bin] = load.get((r.round, r.part, r.bin), 0) + r.tokens
        seen.add((r.doc_id, r.piece))
        assert r.n_pieces == -(-sizes[r.doc_id] // 100)
    assert len(seen) == len(rows) and max(load.values()) <= 100
    assert all(load[r.round, r.part, r.bin] == r.load for r in rows)
    rep = pack.container_report(p, 100).first()
    assert rep.containers == len(load) >= rep.lower_bound and rep.containers <= 1.1 * rep.lower_bound + 6
    same = spark.createDataFrame([(7, "word " * 20, "s", "clash")] * 500, DOCS)
    assert pack.pack_texts(same, 100, part_items=60).groupBy("round", "part").count().agg(F.max("count")).first()[0] < 120
    assert pack.pack_texts(df.limit(0)).count() == 0


# --- mixing ---


@given(st.lists(st.tuples(st.integers(1, 500), st.integers(1, 50)), min_size=1, max_size=30, unique_by=lambda x: x[0]), st.floats(0.01, 0.99))
@settings(max_examples=60, deadline=None)
def test_inclusion_spends_the_budget(hist, f):
    t, n = np.array([h[0] for h in hist]), np.array([h[1] for h in hist])
    budget = f * float((t * n).sum())
    c, size = mix.solve_inclusion(t, n, budget)
    assert float((n * t * np.minimum(1, c * t)).sum()) == pytest.approx(budget, rel=1e-6)
    assert size == round(float((n * np.minimum(1, c * t)).sum()))


@needs_vocabulary
def test_mix_sources(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(1500):
        s = rnd.choice(["Big One", "big-one", "BIG_ONE\t", "big one", "small", "tiny", None, " ", "unlisted"]) if i > 20 else "tiny"
        rows.append((i, rnd.choice([None, "", *[" ".join(["word"] * rnd.randint(1, 60)) for _ in range(8)]]), "small" if s == "small" and i % 3 == 0 else s, "clash"))
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    targets = spark.createDataFrame([("big_one", 5.0, 4), ("Small", 3.0, 3), ("tiny", 3.0, 1), ("absent", 1.0, 2), ("zero", 0.0, 5), ("nulls", None, None)], "source string, weight double, max_repeats int")
    m, report = mix.mix_sources(docs, targets)
    used, rep = m.collect(), {r.source: r for r in report.collect()}
    sizes = {r.doc_id: r.tokens for r in pack.token_counts(docs).collect()}
    assert len({r.doc_id for r in used}) == len(used) and all(r.tokens == sizes[r.doc_id] > 0 for r in used)
    corpus = sum(sizes.values())
    for s, r in rep.items():
        mine = [u for u in used if u.source == s]
        assert max([u.copies for u in mine], default=0) <= (r.max_repeats or 0)
        assert r.used_tokens == sum(u.copies * u.tokens for u in mine)
        assert r.short == (r.max_repeats * r.available < r.weight / 12.0 * corpus)
        assert abs(r.used_tokens - r.allocated) <= max(0.03 * r.allocated, 120)
    assert rep["absent"].short and not rep["zero"].short and not rep["big_one"].short and rep["tiny"].short
    assert {(r.doc_id, r.copies) for r in mix.mix_sources(docs.repartition(3), targets)[0].collect()} == {(r.doc_id, r.copies) for r in used}
    empty = mix.mix_sources(docs.limit(0), targets)
    assert empty[0].count() == 0 and empty[1].count() == 6


# --- shared spans ---


def _brute(texts, span=spans.SPAN):
    seen = {}
    for i, t in texts:
        for k in range(len(t or "") - span + 1):
            seen.setdefault(t[k : k + span], {}).setdefault(i, []).append(k)
    pairs, cover = set(), {i: np.zeros(len(t or ""), bool) for i, t in texts}
    for at in seen.values():
        if len(at) > 1:
            pairs |= set(itertools.combinations(sorted(at), 2))
            for i, ks in at.items():
                for k in ks:
                    cover[i][k : k + span] = True
    return pairs, {i: int(c.sum()) for i, c in cover.items()}


def test_shared_spans_against_brute_force(spark):
    rnd = random.Random(8)
    fresh = lambda n: "".join(rnd.choices(string.ascii_lowercase + "  äß𝒳", k=n))
    bits = [fresh(n) for n in (100, 159, 160, 161, 200, 400, 900)]
    texts = [None, "", "short", fresh(5000), "a" * 700, "b" + "a" * 300, "ab" * 200, "xab" + "ab" * 100, "abc" * 60]
    for _ in range(60):
        texts.append(fresh(rnd.randint(0, 300)) + "".join(rnd.choice(bits) + fresh(rnd.choice([0, 1, 30])) for _ in range(rnd.randint(0, 3))))
    texts += [texts[20], texts[20], texts[21], bits[2], bits[1]]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, "s", "clash") for i, t in rows], DOCS).repartition(5)
    s = spans.SharedSpans(df)
    want, cover = _brute(rows)
    got = [(r.doc_id_a, r.doc_id_b) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert {r.doc_id: r.shared_chars for r in s.coverage().collect()} == cover
    linked = collections.defaultdict(list)
    for r in s.classes().collect():
        linked[r.kind, r.class_id].append(r.doc_id)
    reps = {i for k, ids in linked.items() if k[0] == "copy" for i in ids if i != min(ids)}
    within = {p for ids in linked.values() for p in itertools.combinations(sorted(ids), 2)}
    assert within <= want and {p for p in want if not reps & set(p)} <= within


def test_a_span_in_a_third_of_all_records(spark):
    rnd = random.Random(9)
    fresh = lambda n: "".join(rnd.choices(string.ascii_lowercase, k=n))
    hot = fresh(250)
    texts = [fresh(200) + (hot if i % 3 == 0 else "") + fresh(50) for i in range(1800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert spans.SharedSpans(df).pairs().count() == 600 * 599 // 2


def test_no_spans(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    for d in (df, df.limit(0)):
        s = spans.SharedSpans(d)
        assert s.pairs().count() == 0 and s.spans().count() == 0
        assert [r.shared_chars for r in s.coverage().collect()] == [0] * d.count()


@given(st.text(alphabet="ab", min_size=160, max_size=420), st.integers(0, 50))
@settings(max_examples=40, deadline=None)
def test_fingerprints_of_a_stretch_do_not_depend_on_its_place(t, shift):
    a, b = spans._codes(t), spans._codes("z" * shift + t)
    fa = set(spans.fingerprints(a[:160])[1].tolist())
    assert fa & set(spans.fingerprints(b)[1].tolist())


def test_nodes_of_edges():
    rnd = random.Random(2)
    codes = spans._codes("".join(rnd.choices("abä ", k=400)))
    edge = spans.polynomials(codes, spans.SPAN, spans.BASES[0])
    start, end = spans.node_hashes(edge, codes[: len(edge)], codes[spans.SPAN - 1 :])
    nodes = spans.rolling(codes, spans.SPAN - 1, spans.BASES[0])
    assert (start == nodes[:-1]).all() and (end == nodes[1:]).all()


def test_paths_end_where_nodes_branch_or_colours_change(spark):
    rnd = random.Random(3)
    fresh = lambda n: "".join(rnd.choices(string.ascii_lowercase, k=n))
    x, y, z = fresh(300), fresh(200), fresh(200)
    texts = [x + y, x + y, x + z, x + z, x[:250]]  # copies would be one class
    df = spark.createDataFrame([(i, f"{i}{t}{i}") for i, t in enumerate(texts)], "doc_id long, text string")
    s = spans.SharedSpans(df)
    degrees = [(r.ins, r.outs) for r in s.nodes().collect()]
    assert sorted(d for d in degrees if d != (1, 1)) == [(0, 1), (1, 0), (1, 0), (1, 2)]
    assert s.heads().count() == 4  # x in five, x's end in four, and the two branches


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rnd = random.Random(1)
    codes = spans._codes("".join(rnd.choices("abcd ", k=3000)))
    whole = spans.fingerprints(codes), spans.edges_near(codes, np.array([500, 2000]))
    monkeypatch.setattr(spans, "CHUNK", 256)
    parts = spans.fingerprints(codes), spans.edges_near(codes, np.array([500, 2000]))
    for x, y in zip(itertools.chain(*whole), itertools.chain(*parts), strict=True):
        assert (x == y).all()
