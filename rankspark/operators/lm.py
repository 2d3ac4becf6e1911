"""Re-ranking result lists with smoothed language models and with query expansion.

Input everywhere: results ``qid, doc_id, rank``, term counts ``doc_id, term, tf`` and query terms ``qid, term, n``.
All work is grouped by query; only (document, term) rows that exist are touched: what the smoothing gives to absent
words has a closed form per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankspark.functions.text import preprocess, rerank_tokens
from rankspark.plans.stage import materialise

MU, UNK, UNK_PERCENT, TOP_TERMS, LAMBDA = 250, "<UNK>", 0.5, 10, 0.5  # fixed values


def text_terms(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, term, n``: counts of the re-ranking models' own terms, which are preprocessed first (stop words and
    punctuation go) and then split by the re-ranking tokenizer."""
    words = texts.select(F.col(key), F.explode(rerank_tokens(preprocess(F.col(text)))).alias("term"))
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def query_models(results: DataFrame, tf: DataFrame, mu: float = MU, unk_percent: float = UNK_PERCENT) -> dict[str, DataFrame]:
    """``docs`` (qid, doc_id, rank, len, a), ``terms`` (qid, doc_id, term, tf) and ``background`` (qid, term, b).

    The background is that of the query's own results. <UNK> gets a share of its tokens, rounded down, on top of the
    whole; a document without terms has length 0; a is mu / (len + mu).
    """
    terms = materialise(results.select("qid", "doc_id").join(tf, "doc_id").select("qid", "doc_id", "term", "tf"))
    lens = terms.groupBy("qid", "doc_id").agg(F.sum("tf").alias("len"))
    docs = results.select("qid", "doc_id", "rank").join(lens, ["qid", "doc_id"], "left").na.fill(0, ["len"]).withColumn("a", F.lit(float(mu)) / (F.col("len") + mu))
    cf = terms.groupBy("qid", "term").agg(F.sum("tf").alias("cf"))
    total = cf.groupBy("qid").agg(F.sum("cf").alias("total"))
    unk = total.select("qid", F.lit(UNK).alias("term"), F.floor(F.lit(unk_percent / 100) * F.col("total")).cast("bigint").alias("cf"))
    b = cf.unionByName(unk).join(total, "qid").select("qid", "term", (F.col("cf") / F.col("total")).alias("b"))
    return {"docs": materialise(docs), "terms": terms, "background": materialise(b)}


def known_terms(query: DataFrame, background: DataFrame) -> DataFrame:
    """Query terms with those outside the background merged into <UNK>: ``qid, term, n``."""
    j = query.join(background, ["qid", "term"], "left").withColumn("term", F.when(F.col("b").isNull(), UNK).otherwise(F.col("term")))
    return j.groupBy("qid", "term").agg(F.sum("n").alias("n"))


def _query_log_likelihood(m: dict[str, DataFrame], query: DataFrame, mu: float) -> DataFrame:
    """``qid, doc_id, rank, len, a, ll``: natural log of the product of p(q|D). Terms of probability 0 everywhere
    (an <UNK> rounded to nothing) say nothing and are left out."""
    q = known_terms(query, m["background"]).join(m["background"], ["qid", "term"]).where("b > 0")
    j = m["docs"].join(q, "qid", "left").join(m["terms"], ["qid", "doc_id", "term"], "left")
    p = (F.coalesce("tf", F.lit(0)) + mu * F.col("b")) / (F.col("len") + mu)
    return j.groupBy("qid", "doc_id", "rank", "len", "a").agg(F.coalesce(F.sum(F.col("n") * F.log(p)), F.lit(0.0)).alias("ll"))


def _rerank(scores: DataFrame) -> DataFrame:
    """Result lists are of limited depth, so a query's is sorted in one window."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("old_rank"), F.asc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(w)).select("qid", "doc_id", "score", "rank", "old_rank")


def query_likelihood(results: DataFrame, tf: DataFrame, query: DataFrame, mu: float = MU) -> DataFrame:
    """``qid, doc_id, score, rank, old_rank`` by log p(Q|D)."""
    ll = _query_log_likelihood(query_models(results, tf, mu), query, mu)
    return _rerank(ll.select("qid", "doc_id", F.col("ll").alias("score"), F.col("rank").alias("old_rank")))


def _xlog(x: Column, y: Column) -> Column:
    """x log10(x / y), 0 where x is 0."""
    return F.when(x > 0, x * F.log10(x / y)).otherwise(0.0)


def rm1_rerank(results: DataFrame, tf: DataFrame, query: DataFrame, mu: float = MU, unk_percent: float = UNK_PERCENT) -> DataFrame:
    """``qid, doc_id, score, rank, old_rank`` with score 1 - KL(document || relevance model).

    The relevance model weighs the documents by p(Q|D). With b the background, a document's probability of a word it
    doesn't hold is a b; the divergence is summed over all words as if none were held, and corrected for those that are.
    """
    m = query_models(results, tf, mu, unk_percent)
    ll = _query_log_likelihood(m, query, mu)
    w = Window.partitionBy("qid")
    e = F.exp(F.col("ll") - F.max("ll").over(w))
    docs = materialise(ll.withColumn("e", e).withColumn("lam", F.col("e") / F.sum("e").over(w)).select("qid", "doc_id", "rank", "len", "a", "lam"))
    smooth = docs.groupBy("qid").agg(F.sum(F.col("lam") * F.col("a")).alias("s"))
    held = m["terms"].join(docs, ["qid", "doc_id"])
    direct = held.groupBy("qid", "term").agg(F.sum(F.col("lam") * F.col("tf") / (F.col("len") + mu)).alias("d"))
    r = materialise(m["background"].join(direct, ["qid", "term"], "left").join(smooth, "qid").select("qid", "term", "b", (F.col("b") * F.col("s") + F.coalesce("d", F.lit(0.0))).alias("r")))
    whole = r.groupBy("qid").agg(F.sum("b").alias("b_all"), F.sum(_xlog(F.col("b"), F.col("r"))).alias("k_all"))
    p, ab = (F.col("tf") + mu * F.col("b")) / (F.col("len") + mu), F.col("a") * F.col("b")
    fix = held.join(r, ["qid", "term"]).groupBy("qid", "doc_id").agg(F.sum(_xlog(p, F.col("r")) - _xlog(ab, F.col("r"))).alias("fix"))
    kl = F.col("a") * (F.col("b_all") * F.log10("a") + F.col("k_all")) + F.coalesce("fix", F.lit(0.0))
    j = docs.join(whole, "qid").join(fix, ["qid", "doc_id"], "left")
    return _rerank(j.select("qid", "doc_id", (F.lit(1.0) - kl).alias("score"), F.col("rank").alias("old_rank")))


def expansion_terms(embeddings: DataFrame, query: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """``qid, word, sim, weight, place``: the k words nearest to the query in its own embedding (qid, word, vec of
    length 1). The similarities to the query's words are summed by adding up their vectors first; weights are the
    similarities over their sum. Similarities that agree in nine decimals are ties, which go to the greater word."""
    q = embeddings.join(query.select("qid", F.col("term").alias("word"), "n"), ["qid", "word"])
    dims = q.select("qid", "n", F.posexplode("vec").alias("i", "x")).groupBy("qid", "i").agg(F.sum(F.col("n") * F.col("x")).alias("x"))
    centre = dims.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    sim = F.aggregate(F.zip_with("vec", "c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    w = Window.partitionBy("qid").orderBy(F.round("sim", 9).desc(), F.desc("word"))
    best = embeddings.join(centre, "qid").select("qid", "word", sim.alias("sim")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return best.withColumn("weight", F.try_divide(F.col("sim"), F.sum("sim").over(Window.partitionBy("qid"))))


def expansion_rerank(results: DataFrame, tf: DataFrame, query: DataFrame, embeddings: DataFrame, k: int = TOP_TERMS, lam: float = LAMBDA, mu: float = MU) -> DataFrame:
    """``qid, doc_id, score, rank, old_rank`` with score 1 - KL(expanded query || document)."""
    m = query_models(results, tf, mu)
    share = lambda d: d.withColumn("p", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("qid"))))
    extra = share(known_terms(expansion_terms(embeddings, query, k).select("qid", F.col("word").alias("term"), F.col("weight").alias("n")), m["background"]))
    own = share(known_terms(query, m["background"]))
    both = extra.select("qid", "term", (F.lit(lam) * F.col("p")).alias("p")).unionByName(own.select("qid", "term", (F.lit(1 - lam) * F.col("p")).alias("p")))
    model = both.groupBy("qid", "term").agg(F.sum("p").alias("q")).where("q > 0").join(m["background"], ["qid", "term"]).where("b > 0")
    j = m["docs"].join(model, "qid", "left").join(m["terms"], ["qid", "doc_id", "term"], "left")
    p = (F.coalesce("tf", F.lit(0)) + mu * F.col("b")) / (F.col("len") + mu)
    kl = j.groupBy("qid", "doc_id", "rank").agg(F.coalesce(F.sum(F.col("q") * F.log10(F.col("q") / p)), F.lit(0.0)).alias("kl"))
    return _rerank(kl.select("qid", "doc_id", (F.lit(1.0) - F.col("kl")).alias("score"), F.col("rank").alias("old_rank")))


def relevance_corpus(results: DataFrame, texts: DataFrame) -> DataFrame:
    """``qid, text``: the preprocessed texts (doc_id, seg, text) of a query's results in rank order, for training a
    local embedding. A row is as long as a result list of limited depth."""
    j = results.select("qid", "doc_id", "rank").join(texts, "doc_id").select("qid", F.struct("rank", "seg", preprocess(F.col("text")).alias("t")).alias("s"))
    return j.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), " ").alias("text"))


def train_embedding(corpus: DataFrame, size: int = 100, window: int = 8, iterations: int = 15, seed: int = 1) -> DataFrame:
    """``word, vec`` of length 1, trained on ``text``: skip-gram, so like but not equal to other trainers' vectors."""
    from pyspark.ml.feature import Word2Vec

    tokens = corpus.select(F.split("text", " ").alias("tokens"))
    model = Word2Vec(vectorSize=size, windowSize=window, maxIter=iterations, seed=seed, minCount=1, inputCol="tokens", outputCol="v").fit(tokens)
    from pyspark.ml.functions import vector_to_array

    return unit_vectors(model.getVectors().select("word", vector_to_array("vector").alias("vec")))


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """to[at] += rows, with repeated places added up."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def skip_gram(words: list[str], size: int, window: int, iterations: int, negative: int, seed: int, rate: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Words and their vectors, learnt from one text: skip-gram with negative samples, in batches of pairs. The same
    words in the same order give the same vectors."""
    rng = np.random.default_rng(seed)
    names, text, count = np.unique(np.array(words, object).astype(str), return_inverse=True, return_counts=True)
    inner = ((rng.random((len(names), size)) - 0.5) / size).astype(np.float32)
    outer = np.zeros((len(names), size), np.float32)
    noise = np.cumsum(count**0.75) / (count**0.75).sum()
    at = np.arange(len(text))
    for k in range(iterations):
        reach, lr = rng.integers(1, window + 1, len(text)), rate * max(1 - k / iterations, 0.05)
        ctx = [np.stack([text[:-d][ok], text[d:][ok]]) for d in range(1, window + 1) if len(text) > d for ok in [reach[:-d] >= d] if ok.any()]
        if not len(at) or not ctx:
            break
        pairs = np.concatenate(ctx, axis=1)
        pairs = np.where(rng.random(pairs.shape[1]) < 0.5, pairs, pairs[::-1])[:, rng.permutation(pairs.shape[1])]
        for i in range(0, pairs.shape[1], 2048):
            a, b = pairs[:, i : i + 2048]
            b = np.concatenate([b[:, None], np.searchsorted(noise, rng.random((len(b), negative)))], axis=1)
            b = np.minimum(b, len(names) - 1)
            v, u = inner[a], outer[b]
            g = -1 / (1 + np.exp(-np.clip(np.einsum("ij,ikj->ik", v, u), -30, 30)))
            g[:, 0] += 1
            step = np.clip(lr * np.einsum("ik,ikj->ij", g, u), -0.1, 0.1).astype(np.float32)
            _add_rows(outer, b.ravel(), np.clip(lr * g[:, :, None] * v[:, None, :], -0.1, 0.1).reshape(-1, size).astype(np.float32))
            _add_rows(inner, a, step)
    return names.tolist(), inner


def local_embeddings(corpus: DataFrame, size: int = 50, window: int = 8, iterations: int = 2, negative: int = 5, seed: int = 1) -> DataFrame:
    """``qid, word, vec`` of length 1: an embedding of its own for each query, trained on the ``text`` of its row of
    ``qid, text`` (relevance_corpus(): as long as a result list of limited depth). Queries are trained side by side,
    one row at a time. Like but not equal to other trainers' vectors; an empty text gives no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qid, text in zip(pdf["qid"], pdf["text"], strict=True):
                names, vectors = skip_gram((text or "").split(), size, window, iterations, negative, seed)
                if names:
                    yield pd.DataFrame({"qid": qid, "word": names, "vec": list(vectors)})

    kind = corpus.schema["qid"].dataType.simpleString()
    n = max(1, min(corpus.count(), 10_000))  # a query is a task
    return unit_vectors(corpus.select("qid", "text").repartition(n, "qid").mapInPandas(run, f"qid {kind}, word string, vec array<double>"))


def unit_vectors(df: DataFrame, vec: str = "vec") -> DataFrame:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    # In the lambda alone the norm would be computed again for every number.
    return df.withColumn(vec, F.zip_with(vec, F.array_repeat(norm, F.size(vec)), lambda x, n: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))))
