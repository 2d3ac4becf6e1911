"""Queries of the subpackage: name -> callable(spark, sf_dir). All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankspark.llm import distinctive, fuse, mix, onerank, pack, spans, termstats, topn
from rankspark.operators.packed import stand_in_list
from rankspark.operators.positions import exact_positions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of docstore too rare or too common to help a search."""
    return termstats.term_frequencies(table(spark, sf, "docstore")).where("mark is not null").select("term", "mark")


@query
def p1_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    return termstats.term_frequencies(table(spark, sf, "docstore")).select("term", "occurrences", "records", "mark")


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms found by their score and confirmed: used at least 4 times in a record, standing in 2 to 6 records."""
    return distinctive.rare_and_repeated(table(spark, sf, "docstore")).select("docid", "term")


@query
def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of every record with its score."""
    return distinctive.distinctive_terms(table(spark, sf, "docstore")).select("docid", "term", "tf", "records", F.round("score", 6).alias("score"))


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every ranking."""
    return topn.top_n(table(spark, sf, "runs"), 10).select("run_id", "query_number", "docno")


@query
def p4_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every ranking with score and position."""
    return topn.top_n(table(spark, sf, "runs"), 10).select("run_id", "query_number", "docno", "score", "pos")


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The majority winner of each query, found along the closeness ranking."""
    return onerank.majority_winners(onerank.closeness(table(spark, sf, "engine_ranks")))


@query
def p5_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """One ranking per query; equal closeness is ordered by doc_id."""
    c = onerank.closeness(table(spark, sf, "engine_ranks")).select("qid", "doc_id", F.round("closeness", 9).alias("closeness"))
    return exact_positions(c, ["qid"], [F.col("closeness").desc(), F.col("doc_id").asc()], pos="position")


def _fused(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    stand_ins = stand_in_list(table(spark, sf, "stand_ins"))
    return fuse.fuse_records(table(spark, sf, "metadata"), table(spark, sf, "source_trust"), stand_ins)


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The row each field's value comes from, of every cord_uid with several rows, under the strict prior."""
    return _fused(spark, sf)[0].where("n_rows > 1 and posterior is not null").select("cord_uid", "field_name", "row_id")


@query
def p6_posterior(spark: SparkSession, sf: str) -> DataFrame:
    """The value of greatest posterior by votes alone, per cord_uid and field."""
    return _fused(spark, sf)[0].select("cord_uid", "field_name", "n_sources", F.col("best_row_id").alias("row_id"), F.round("best_posterior", 6).alias("posterior"))


@query
def p6_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One record per cord_uid with its surviving values."""
    return fuse.surviving_values(table(spark, sf, "metadata"), _fused(spark, sf)[0])


@query
def p6_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What was learnt of the sources' accuracy and copying."""
    return fuse.source_report(spark, _fused(spark, sf)[1])


@query
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents the packing had to divide."""
    return pack.pack_texts(table(spark, sf, "documents")).where("n_pieces > 1").select("doc_id").distinct()


@query
def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document with its container."""
    return pack.pack_texts(table(spark, sf, "documents"))


@query
def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used, the fill and the lower bound."""
    return pack.container_report(pack.pack_texts(table(spark, sf, "documents")))


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that fall short of their target though the mix uses them as often as it may."""
    _, report = mix.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    return report.where("short and used_tokens < target").select("source")


@query
def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mix: how often each document is used."""
    return mix.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


@query
def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """The shares asked for and reached."""
    return mix.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that share a span of at least 160 characters."""
    return spans.SharedSpans(table(spark, sf, "documents")).pairs()


@query
def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The links of p10_found as classes of linked documents, which grow with the documents and not with their pairs."""
    return spans.SharedSpans(table(spark, sf, "documents")).classes()


@query
def p10_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The stretches of each document that stand in another too."""
    return spans.SharedSpans(table(spark, sf, "documents")).spans()


@query
def p10_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document stands elsewhere."""
    return spans.SharedSpans(table(spark, sf, "documents")).coverage()
