"""Ranked TF-IDF search for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankspark.functions.text import index_tokens
from rankspark.operators.bpe import encode_tokens
from rankspark.operators.index import document_frequencies, document_norms, read_index, term_frequencies, tf_weight
from rankspark.plans.stage import materialise, maybe_broadcast

COMMON_SHARE, COMMON_FROM = 0.25, 10_000  # fixed values: terms of more than a quarter of a large collection are left out


def query_terms(queries: DataFrame, dictionary: DataFrame, least: int = 10, merges: DataFrame | None = None) -> DataFrame:
    """``qid, term, qtf`` of queries ``qid, title, description``: every title token, and of the description's tokens
    the rarer half (at least ``least``): those in the dictionary by document frequency ascending, then unknown ones by
    length; ties by term and place. With ``merges`` tokens are byte-pair tokens, as in an index made with them."""
    if merges is None:
        title = queries.select("qid", F.explode(index_tokens(F.col("title"))).alias("term"))
        desc = queries.select("qid", F.posexplode(index_tokens(F.col("description"))).alias("pos", "term"))
    else:
        part = lambda c: encode_tokens(queries.select(F.col("qid").alias("doc_id"), F.col(c).alias("text")), merges).select(F.col("doc_id").alias("qid"), "term")
        title, desc = part("title"), part("description").withColumn("pos", F.lit(0))  # equal tokens need no order
    known = desc.join(dictionary.select("term", "df"), "term", "left")
    oov = F.col("df").isNull().cast("int")
    w = Window.partitionBy("qid").orderBy(oov, F.coalesce("df", F.length("term")), "term", "pos")
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    picked = known.withColumns({"k": F.row_number().over(w), "n": n}).where(F.col("k") <= F.greatest(F.floor(F.col("n") / 2), F.lit(least)))
    return title.unionByName(picked.select("qid", "term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def tfidf_scores(postings: DataFrame, dictionary: DataFrame, norms: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """``qid, doc_id, score``: sum of (1 + log2 tf)(1 + log2 qtf) idf^2 over the terms, divided by the document norm.
    Query terms are joined to the dictionary and go to the postings if they are few; the shuffle is on (query, document) after partial sums."""
    common = (F.col("df") > COMMON_SHARE * n_docs) & F.lit(n_docs > COMMON_FROM)
    q = terms.join(dictionary, "term").where(~common).select("qid", "term", (tf_weight(F.col("qtf")) * F.col("idf") * F.col("idf")).alias("w"))
    s = postings.join(maybe_broadcast(q), "term").groupBy("qid", "doc_id").agg(F.sum(tf_weight(F.col("tf")) * F.col("w")).alias("dot"))
    return s.join(norms, "doc_id").select("qid", "doc_id", (F.col("dot") / F.col("norm")).alias("score"))


def top_k(scores: DataFrame, k: int = 100, digits: int | None = None) -> DataFrame:
    """``qid, doc_id, score, rank``: the k best per query, ties by doc_id descending."""
    s = scores if digits is None else scores.withColumn("score", F.round("score", digits))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id"))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 100, doc_id: str = "doc_id", text: str = "text", digits: int | None = None, merges: DataFrame | None = None) -> DataFrame:
    """Index ``docs`` and answer ``queries`` (qid, title, description); with ``merges`` both in byte-pair tokens."""
    tf = materialise(term_frequencies(docs, doc_id, text, merges))
    n = docs.select(doc_id).where(F.col(doc_id).isNotNull()).distinct().count()
    df = materialise(document_frequencies(tf, n))
    # The dictionary goes to the counts if it is small; else they meet by term, the hottest terms split (adaptive skew join).
    return top_k(tfidf_scores(tf, df, document_norms(tf, maybe_broadcast(df)), query_terms(queries, df, merges=merges), n), k, digits)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 100, digits: int | None = None) -> DataFrame:
    """Answer ``queries`` from the tables of write_index(), tokenised as the index was; only the postings of the queries'
    terms are used."""
    t = read_index(spark, path)
    terms = query_terms(queries, t["dictionary"], merges=t.get("merges"))
    return top_k(tfidf_scores(t["postings"], t["dictionary"], t["norms"], terms, t["config"].first().n_docs), k, digits)
