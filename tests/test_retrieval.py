import math
import random
import time

import pytest
from pyspark.sql import functions as F

from rankspark.functions import codec, text
from rankspark.operators import bpe, fusion, index, lm, search
from rankspark.plans import queries
from rankspark.sources import corpus, trec


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_text_functions(spark):
    df = spark.createDataFrame([("The Ärzte, don't STOP sars-cov-2 at 3.5! the,",)], "t string")
    t = F.col("t")
    assert df.select(text.index_tokens(t)).first()[0][:3] == ["the", "Ärzte", "don"]
    assert df.select(text.preprocess(t)).first()[0] == "ärzte stop sarscov2 35 the"
    assert df.select(text.preprocess(t, stop_words=False, punctuation=False, digits=True)).first()[0].endswith("sars-cov-<NUMBER> at <NUMBER>! the,")
    assert df.select(text.preprocess(F.lit(None).cast("string"))).first()[0] == ""
    assert df.select(text.name_key(F.lit(" Citation_ Garden-\t"))).first()[0] == "citationgarden"
    every = spark.createDataFrame([(chr(i),) for i in [*range(0x3100), 0xFEFF, 0xFFFF]], "c string")
    assert every.where((text.trim_ws(F.col("c")) == "") != F.col("c").rlike(f"^{text.WS}$")).count() == 0
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 179


def test_codecs(spark):
    rows = [([0, 1, 127, 128, 16384, 2**31 - 1],), ([],), ([5],)]
    df = spark.createDataFrame(rows, "a array<int>")
    out = df.select("a", codec.vbyte_encode("a").alias("v"), codec.fixed_encode("a").alias("f")).select("a", "v", codec.vbyte_decode("v").alias("b"), codec.fixed_decode("f").alias("c")).collect()
    assert all(r.a == r.b == r.c for r in out)
    assert bytes(out[0].v[:2]) == b"\x80\x81"
    size = df.select(F.aggregate(F.transform("a", codec.encoded_bytes), F.lit(0), lambda x, y: x + y).alias("n"), F.length(codec.vbyte_encode("a")).alias("m"))
    assert all(r.n == r.m for r in size.collect())
    g = spark.createDataFrame([([3, 7, 20],)], "a array<int>").select(codec.gaps(F.col("a")).alias("g")).select("g", codec.ungaps("g").alias("u")).first()
    assert g.g == [3, 4, 13] and g.u == [3, 7, 20]


def test_index_round_trip_and_search(spark, tmp_path):
    docs = _docs(spark, ["red fish blue fish", "one fish", None, "", "two\tbirds"])
    index.write_index(str(tmp_path), docs)
    t = index.read_index(spark, str(tmp_path))
    assert t["config"].first().n_docs == 5
    assert {(r.doc_id, r.tf) for r in index.postings_of(t["postings"], spark.createDataFrame([("fish",)], "term string")).collect()} == {(0, 2), (1, 1)}
    assert t["dictionary"].where("term = 'fish'").first().idf == pytest.approx(math.log2(1 + 5 / 2))
    q = spark.createDataFrame([(1, "fish", "zzz"), (2, "nothing here", "")], "qid int, title string, description string")
    top = search.search(docs, q, 10).collect()
    assert {(r.qid, r.doc_id) for r in top} == {(1, 0), (1, 1)}
    stored = search.search_index(spark, str(tmp_path), q, 10).collect()
    assert {(r.qid, r.doc_id, round(r.score, 9)) for r in stored} == {(r.qid, r.doc_id, round(r.score, 9)) for r in top}
    packed = index.packed_postings(t["postings"], index.numbered_documents(docs)).where("term = 'fish'").first()
    assert [(p.doc_idx, p.tf) for p in packed.postings] == [(0, 2), (1, 1)]


def test_common_terms_are_left_out_of_large_collections(spark):
    tf = spark.createDataFrame([(1, "a", 1)], "doc_id long, term string, tf long")
    d = spark.createDataFrame([("a", 6000, 1.0)], "term string, df long, idf double")
    norms = spark.createDataFrame([(1, 1.0)], "doc_id long, norm double")
    q = spark.createDataFrame([(1, "a", 1)], "qid int, term string, qtf long")
    assert search.tfidf_scores(tf, d, norms, q, 20000).count() == 0
    assert search.tfidf_scores(tf, d, norms, q, 10000).count() == 1


def test_rm1_against_dense(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    docs = {i: [rnd.choice(words) for _ in range(rnd.randint(0, 400))] for i in range(6)}
    tf = spark.createDataFrame([(i, w, d.count(w)) for i, d in docs.items() for w in set(d)], "doc_id long, term string, tf long")
    res = spark.createDataFrame([(1, i, i + 1) for i in docs], "qid int, doc_id long, rank int")
    q = spark.createDataFrame([(1, "w1", 2), (1, "w2", 1), (1, "unseen", 1)], "qid int, term string, n long")
    total = sum(map(len, docs.values()))
    b = {w: sum(d.count(w) for d in docs.values()) / total for w in words} | {"<UNK>": int(0.005 * total) / total}
    b = {w: x for w, x in b.items() if x > 0}
    p = {i: {w: (d.count(w) + 250 * x) / (len(d) + 250) for w, x in b.items()} for i, d in docs.items()}
    like = {i: p[i]["w1"] ** 2 * p[i]["w2"] * p[i].get("<UNK>", 1.0) for i in docs}
    r = {w: sum(p[i][w] * like[i] for i in docs) / sum(like.values()) for w in b}
    want = {i: 1 - sum(p[i][w] * math.log10(p[i][w] / r[w]) for w in b) for i in docs}
    got = {x.doc_id: x.score for x in lm.rm1_rerank(res, tf, q).collect()}
    assert got == pytest.approx(want, abs=1e-10)
    ql = {x.doc_id: x.score for x in lm.query_likelihood(res, tf, q).collect()}
    assert ql == pytest.approx({i: math.log(v) for i, v in like.items()}, abs=1e-9)


def test_expansion(spark):
    e = lm.unit_vectors(spark.createDataFrame([(1, "a", [3.0, 4.0]), (1, "b", [4.0, 3.0]), (1, "c", [-1.0, 0.0])], "qid int, word string, vec array<double>"))
    q = spark.createDataFrame([(1, "a", 2)], "qid int, term string, n long")
    rows = lm.expansion_terms(e, q, 2).orderBy("place").collect()
    assert [r.word for r in rows] == ["a", "b"] and rows[0].sim == pytest.approx(2.0) and rows[1].sim == pytest.approx(1.92)
    tf = spark.createDataFrame([(1, "a", 1), (2, "b", 3), (2, "x", 9)], "doc_id long, term string, tf long")
    res = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "qid int, doc_id long, rank int")
    assert {r.doc_id for r in lm.expansion_rerank(res, tf, q, e).collect()} == {1, 2}
    assert trec.expansion_lines(lm.expansion_terms(e, q, 2)).first().value == "1: a b"


def test_expansion_topk_asks_for_every_twentieth_vector(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], i // 3 % 2) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    want = {}
    for q in range(0, 100, 20):
        own = [i for i in unit if label[i] == label[q]]
        words = [q] + [min(i for i in own if i > q)] * 2 * (q % 40 == 0)
        sim = {i: sum(sum(x * y for x, y in zip(unit[i], unit[w], strict=True)) for w in words) for i in own}
        want |= {(q, str(i)): sim[i] for i in sorted(own, key=lambda i: -sim[i])[:10]}
    got = {(r.qid, r.word): r.sim for r in queries.QUERIES["expansion_topk"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_reranking_covers_the_whole_list(spark, tmp_path):
    n = 130
    docs = [(i, "fish " * (i % 7 + 1) + f"word{i} " * (i % 3 + 1)) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "fish", "fish")], "query_number int, title string, description string").write.parquet(str(tmp_path / "topics.parquet"))
    listed = {r.doc_id for r in search.search(_docs(spark, [t for _, t in docs]), spark.createDataFrame([(1, "fish", "fish")], "qid int, title string, description string"), 100, digits=6).collect()}
    assert len(listed) == 100
    # what a document's length and fish give, the background being that of all 100 listed ones
    size, fish = {i: len(t.split()) for i, t in docs}, {i: i % 7 + 1 for i in range(n)}
    b = sum(fish[i] for i in listed) / sum(size[i] for i in listed)
    want = {i: math.log((fish[i] + 250 * b) / (size[i] + 250)) for i in listed}
    assert {r.doc_id: r.score for r in queries.QUERIES["query_likelihood"](spark, str(tmp_path)).collect()} == pytest.approx(want, abs=1e-6)
    for name in ("rm1_rerank", "expansion_rerank"):
        assert {r.doc_id for r in queries.QUERIES[name](spark, str(tmp_path)).collect()} == listed
    vec = queries._count_vectors(spark.createDataFrame([(1, 1, "a", 2), (1, 77, "a", 5)], "qid int, rank int, term string, tf long")).first().vec
    assert len(vec) == 100 and vec[0] == 2 and vec[76] == 5 and sum(vec) == 7


ROWS = [(1, 1, {1: 1, 2: 2}, "a", 0), (0, 1, {1: 2, 2: None}, "b", 1), (2, 1, {1: 2, 2: 1}, "c", 2), (0, 1, {1: None, 2: None}, "d", 3)]


def _ranks(spark):
    return spark.createDataFrame(ROWS, "label int, qid int, ranks map<int,int>, doc_id string, seq long")


def test_fusion(spark):
    f = _ranks(spark)
    got = {r.doc_id: r.score for r in fusion.rrf(f).collect()}
    assert got == pytest.approx({"a": 1 / 101 + 1 / 102, "b": 1 / 102, "c": 1 / 102 + 1 / 101, "d": 0.0})
    assert [r.doc_id for r in fusion.rrf(f).orderBy("rank").collect()] == ["a", "c", "b", "d"]  # a tie keeps first appearance
    assert {r.doc_id: r.score for r in fusion.borda(f).collect()} == {"a": 3, "b": 1, "c": 3, "d": 0}
    # b and c have rank 2 in engine 1: equal ranks count for the later one
    assert {r.doc_id: r.score for r in fusion.condorcet(f).collect()} == {"a": 2, "b": 1, "c": 2, "d": 0}
    w = {r.engine: r.weight for r in fusion.engine_weights(f).collect()}
    assert sum(w.values()) == pytest.approx(1)
    assert {r.doc_id for r in fusion.weighted_borda(f).collect()} == set("abcd")
    assert {r.doc_id: r.score for r in fusion.bayes_fuse(f).collect()}["d"] == 0


def _condorcet_by_rows(rows):
    """Wins per document, every row of the query compared with every later one."""
    wins = dict.fromkeys((r[3] for r in rows), 0)
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            v = 0
            for e in {*a[2], *b[2]}:
                x, y = a[2].get(e), b[2].get(e)
                v += 0 if x is None and y is None else 1 if y is None else -1 if x is None else 1 if x < y else -1
            if v:
                wins[a[3] if v > 0 else b[3]] += 1
    return wins


def test_condorcet_compares_every_row_of_a_document(spark):
    schema = "label int, qid int, ranks map<int,int>, doc_id string, seq long"
    twice = [(0, 1, {1: 9}, "a", 0), (0, 1, {1: 5, 2: 5}, "b", 1), (0, 1, {1: 1, 2: 1, 3: 1}, "a", 2)]
    # a's later row beats its own earlier one and b; b beats a's earlier row
    assert {r.doc_id: (r.score, r.rank) for r in fusion.condorcet(spark.createDataFrame(twice, schema)).collect()} == {"a": (2, 1), "b": (1, 2)}
    rnd = random.Random(3)
    rows = [(0, 1, {e: rnd.choice([None, 1, 2, 3, 4]) for e in rnd.sample(range(5), 3)}, rnd.choice("abcdef"), i) for i in range(25)]
    assert {r.doc_id: r.score for r in fusion.condorcet(spark.createDataFrame(rows, schema)).collect()} == _condorcet_by_rows(rows)


def test_bpe(spark):
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a")]
    ranks = {m: i for i, m in enumerate(merges)}
    assert bpe.encode_word("abcab", ranks) == ["abc", "ab"]
    assert bpe.encode_word("aaaa", {("a", "a"): 1, ("aa", "aa"): 0}) == ["aa", "aa"]  # its turn has passed
    docs = _docs(spark, ["low low lower", "newest lowest", None])
    learnt = bpe.train(docs, 4)
    assert learnt[0] == ("l", "o") and learnt[1] == ("lo", "w")
    m = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(learnt)], "rank int, left string, right string")
    tokens = bpe.encode_tokens(docs, m)
    assert tokens.where("term like 'low%'").count() == 4
    assert "".join(sorted("".join(r.term for r in tokens.where("doc_id = 1").collect()))) == "".join(sorted("newestlowest"))


def test_merges_in_batches_are_those_of_training_one_at_a_time(spark):
    rnd = random.Random(8)
    for case in range(3):
        words = ["".join(rnd.choices("abcdeé", weights=[5, 4, 3, 2, 1, 1], k=rnd.randint(1, 9))) for _ in range(60)]
        text = " ".join(rnd.choices(words, k=300))
        want: list[tuple[str, str]] = []
        for _ in range(30):
            ranks, pairs = {m: i for i, m in enumerate(want)}, {}
            for w in text.split():
                parts = bpe.encode_word(w, ranks)
                for pair in zip(parts, parts[1:], strict=False):
                    pairs[pair] = pairs.get(pair, 0) + 1
            want.append(min(pairs, key=lambda p: (-pairs[p], p)))
        assert bpe.train(_docs(spark, [text]).repartition(3), 30, batch=[1000, 7, 2][case]) == want


def test_bpe_search_splits_the_queries_too(spark, tmp_path):
    docs = _docs(spark, ["lowest newest", "other words"])
    m = spark.createDataFrame([(0, "l", "o"), (1, "lo", "w")], "rank int, left string, right string")
    q = spark.createDataFrame([(1, "lowest", "low")], "qid int, title string, description string")
    top = [(r.doc_id, round(r.score, 9)) for r in search.search(docs, q, 10, merges=m).orderBy("rank").collect()]
    assert top[0][0] == 0
    index.write_index(str(tmp_path), docs, merges=m)
    assert [(r.doc_id, round(r.score, 9)) for r in search.search_index(spark, str(tmp_path), q, 10).orderBy("rank").collect()] == top


@pytest.mark.parametrize("kind", ["vbyte", "fixed"])
def test_encoded_lists_over_several_blocks(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(index, "packed_postings", lambda tf, d, f=index.packed_postings: f(tf, d, 3))
    docs = _docs(spark, ["x " * (i % 200 + 1) + ("y" if i % 5 else "") for i in range(20)])
    index.write_index(str(tmp_path), docs, encoded=kind)
    got = {(r.term, r.doc_id, r.tf) for r in index.read_lists(spark, str(tmp_path), spark.createDataFrame([("x",), ("y",)], "term string")).collect()}
    assert got == {("x", i, i % 200 + 1) for i in range(20)} | {("y", i, 1) for i in range(20) if i % 5}


def test_gaps_of_a_long_list_take_time_in_proportion(spark):
    """An array that is an expression was made again for each of its numbers: 60,000 postings took more than a minute."""
    n = 60_000
    packed = spark.range(1).select(F.lit("x").alias("term"), F.lit(0).alias("block"), F.lit(n).alias("n"), F.lit(5).cast("long").alias("before"), F.expr(f"transform(sequence(1, {n}), i -> struct(bigint(5 + 3 * i) AS doc_idx, bigint(1) AS tf))").alias("postings"))
    packed = packed.repartition(1)
    began = time.monotonic()
    r = index.block_gaps(packed).select(F.size("gaps").alias("n"), F.array_distinct("gaps").alias("d"), F.get("gaps", F.lit(0)).alias("first"), F.size("tfs").alias("m")).first()
    assert (r.n, r.d, r.first, r.m) == (n, [3], 3, n)
    assert time.monotonic() - began < 15
    assert [r.g for r in spark.createDataFrame([([],), (None,), ([4],)], "a array<int>").select(codec.gaps(F.col("a")).alias("g")).collect()] == [[], None, [4]]


def test_vbyte_roundtrip_of_a_full_block(spark, tmp_path):
    """One term in 65,536 documents, the longest list there is in a row: its time grew with the square of that."""
    n = index.BLOCK
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a a").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    assert [tuple(r) for r in queries.QUERIES["vbyte_roundtrip"](spark, str(tmp_path)).collect()] == [("a", n, n, 4 * n, True)]
    assert time.monotonic() - began < 45


def test_encoded_index_has_the_tables_of_a_plain_one(spark, tmp_path):
    docs = spark.createDataFrame([(7, "a b a"), (None, "a z"), (3, None), (7, "b c"), (9, "a")], "doc_id long, text string")
    index.write_index(f"{tmp_path}/plain", docs)
    index.write_index(f"{tmp_path}/lists", docs, encoded="vbyte")
    plain, lists = index.read_index(spark, f"{tmp_path}/plain"), index.read_index(spark, f"{tmp_path}/lists")
    for t in ("postings", "dictionary", "norms"):
        assert plain[t].columns == lists[t].columns
        assert sorted(map(str, plain[t].collect())) == sorted(map(str, lists[t].collect()))
    got = index.read_lists(spark, f"{tmp_path}/lists", spark.createDataFrame([("a",), ("b",), ("z",)], "term string"))
    assert {tuple(r) for r in got.collect()} == {(7, "a", 2), (9, "a", 1), (7, "b", 2)}


def test_local_embeddings_put_words_of_one_context_together(spark):
    rnd = random.Random(3)
    text = " ".join(" ".join(rnd.choices(g, k=12)) for _ in range(150) for g in [["sun", "sea", "sand"], ["ice", "snow", "cold"]])
    e = lm.local_embeddings(spark.createDataFrame([(1, text), (2, ""), (3, None)], "qid int, text string"), size=16, window=3)
    v = {r.word: r.vec for r in e.collect()}
    assert set(v) == {"sun", "sea", "sand", "ice", "snow", "cold"}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert dot("sun", "sea") > dot("sun", "ice") and dot("ice", "snow") > dot("sea", "snow")
    assert {r.word: r.vec for r in lm.local_embeddings(spark.createDataFrame([(1, text)], "qid int, text string"), size=16, window=3).collect()} == v


def test_condorcet_in_blocks_and_with_many_engines(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(0, q, {e: rnd.choice([None, 1, 2, 3]) for e in rnd.sample(range(6), 3)}, f"d{i}", 100 * q + i) for q in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "label int, qid int, ranks map<int,int>, doc_id string, seq long")
    want = {(q, d): n for q in (1, 2) for d, n in _condorcet_by_rows([r for r in rows if r[1] == q]).items()}
    monkeypatch.setattr(fusion, "dealt", lambda *a, f=fusion.dealt: f(*a, block=7))
    assert {(r.qid, r.doc_id): r.score for r in fusion.condorcet(df).collect()} == want
    monkeypatch.setattr(fusion, "UNROLLED", 3)
    assert {(r.qid, r.doc_id): r.score for r in fusion.condorcet(df).collect()} == want


def test_bpe_learns_from_the_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "BPE_MERGES", 6)
    texts = ["été étage étang", "straße strasse stein stein", "niña año", None, "baaaab aaa"]
    _docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x", "zzz zzz zzz")], "query_number int, title string, description string").write.parquet(str(tmp_path / "topics.parquet"))
    want: list[tuple[str, str]] = []
    for _ in range(6):
        ranks, pairs = {m: i for i, m in enumerate(want)}, {}
        for w in " ".join(t for t in texts if t).split():
            parts = bpe.encode_word(w, ranks)
            for pair in zip(parts, parts[1:], strict=False):
                pairs[pair] = pairs.get(pair, 0) + 1
        want.append(min(pairs, key=lambda p: (-pairs[p], p)))
    learnt = queries.QUERIES["bpe_train"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.left, r.right) for r in learnt] == want
    ranks = {m: i for i, m in enumerate(want)}
    tokens = {i: sum(len(bpe.encode_word(w, ranks)) for w in t.split()) for i, t in enumerate(texts) if t}
    assert {r.doc_id: r.tokens for r in queries.QUERIES["bpe_encode"](spark, str(tmp_path)).collect()} == tokens


def test_read_merges(spark, tmp_path):
    (tmp_path / "m").write_bytes(b"t h\n\xc3 \xa9\nth e\n")
    rows = bpe.read_merges(spark, str(tmp_path / "m")).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [(0, "t", "h"), (1, "\xc3", "\xa9"), (2, "th", "e")]
    bpe.write_merges(spark, [(r.left, r.right) for r in rows], str(tmp_path / "again"))
    assert (tmp_path / "again").read_bytes() == (tmp_path / "m").read_bytes()
    ranks = {(r.left, r.right): r.rank for r in rows}
    assert bpe.encode_word("thé", ranks) == ["th", "\xc3\xa9"]


def test_readers(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<X><DOC><DOCID>d1</DOCID><TITLE>T</TITLE><CONTENT>C c</CONTENT></DOC><DOC><DOCID>d2</DOCID></DOC></X>")
    assert [tuple(r) for r in corpus.read_xml_documents(spark, str(tmp_path / "d.xml")).orderBy("doc_id").collect()] == [("d1", "T", "C c"), ("d2", "", "")]
    (tmp_path / "t").write_text("<top>\n<num> Number: 5\n<title> a b\n<desc> Description:\nlong one\n<narr> n\n</top>\n<top><num> Number: 6\n<title>x\n<desc>y\n</top>")
    assert [tuple(r) for r in corpus.read_topics(spark, str(tmp_path / "t")).collect()] == [(5, "a b", "long one"), (6, "x", "y")]
    (tmp_path / "e").write_text("2 2\nw 3 4\nv 0 0\n")
    assert {r.word: r.vec for r in corpus.read_embeddings(spark, str(tmp_path / "e")).collect()} == {"w": [0.6, 0.8], "v": [0.0, 0.0]}
    (tmp_path / "a").write_text("2 qid:7 1:3 2:NULL #docid = G1 inc = 0.5 prob = 0.25\n")
    r = trec.read_engine_ranks(spark, str(tmp_path / "a")).first()
    assert (r.label, r.qid, r.ranks, r.doc_id, r.inc, r.prob) == (2, 7, {1: 3, 2: None}, "G1", 0.5, 0.25)
    (tmp_path / "m.csv").write_text('cord_uid,title,abstract,pdf_json_files,pmc_json_files\nu1,"A, b","x ""q""",p/1.json; p/2.json,\nu2,T,,,\n')
    m = corpus.read_metadata(spark, str(tmp_path / "m.csv"))
    assert m.where("cord_uid = 'u1'").first().pdf_files == ["p/1.json", "p/2.json"]
    bodies = spark.createDataFrame([("p/1.json", 0, "one"), ("p/2.json", 0, "two")], "file string, seg int, text string")
    texts = corpus.document_texts(m, bodies).orderBy("cord_uid", "seg").collect()
    assert [(t.cord_uid, t.text) for t in texts] == [("u1", "one"), ("u1", "two"), ("u2", None), ("u2", "T")]
    lines = trec.run_lines(spark.createDataFrame([(1, "d", 1, 0.5)], "qid int, doc_id string, rank int, score double"), "tag")
    trec.write_lines(lines, str(tmp_path / "run"))
    back = trec.read_run(spark, str(tmp_path / "run")).first()
    assert (back.qid, back.docno, back.rank, back.sim, back.run_id) == ("1", "d", 1, 0.5, "tag")
    assert trec.qrels_lines(_ranks(spark)).first().value == "1 0 c 2"
    sample = spark.createDataFrame([(f"f{i}", f"d{j}") for i in range(4) for j in range(10)], "file string, doc_id string")
    assert corpus.training_sample(sample).count() == 4


def test_article_and_xml_topics(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"body_text": [{"text": "p1"}, {"text": "p2"}]}')
    assert [r.text for r in corpus.read_article_bodies(spark, str(tmp_path / "x.json")).orderBy("seg").collect()] == ["p1", "p2"]
    (tmp_path / "t.xml").write_text('<topics><topic number="3"><query>q</query><question>w?</question><narrative>n</narrative></topic></topics>')
    assert tuple(corpus.read_xml_topics(spark, str(tmp_path / "t.xml")).first()) == (3, "q", "w?", "n")


def test_streaming_statistics(spark, tmp_path):
    from rankspark.streaming import stats

    _docs(spark, ["a b a", "b"]).write.parquet(str(tmp_path / "in"))
    s = stats.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string")
    stats.term_statistics_stream(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.term: (r.tf, r.df) for r in stats.read_term_statistics(spark, str(tmp_path / "out")).collect()} == {"a": (2, 1), "b": (2, 2)}


def test_bitmap_prefilter_loses_no_key(spark):
    from rankspark.plans.stage import maybe_in, written

    df, keys = spark.range(-500, 4000).withColumnRenamed("id", "x"), spark.range(-100, 4000, 7).withColumnRenamed("id", "k")
    for bits in (1 << 15, 1 << 20):
        got = maybe_in(df, "x", keys, bits)
        assert keys.join(got, F.col("k") == F.col("x"), "left_anti").count() == 0
        assert got.count() <= df.count()
    assert maybe_in(df, "x", keys.limit(0)).count() == 0
    assert written(keys).count() == keys.count()
