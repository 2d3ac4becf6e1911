"""Readers and writers of the evaluation file formats. Schemas are explicit; malformed lines are errors.

Every reader splits lines on white space and skips blank lines. ``read_run`` and ``read_qrels`` also say which
columns of the line they use, so that other column orders can be read with ``fields``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    t = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(t.alias("line")).where("line != ''").select(F.split("line", r"\s+").alias("f"), "line")


def _need(df: DataFrame, least: int, most: int | None = None) -> DataFrame:
    bad = F.size("f") < least
    if most is not None:
        bad |= F.size("f") > most
    return df.withColumn("f", F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), F.col("line"))).cast("array<string>")).otherwise(F.col("f")))


def _f(i: int, kind: str = "string") -> Column:
    return F.col("f")[i].cast(kind)


def read_run(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``qid, docno, rank, sim float, run_id, line_no`` of 6-column rankings; columns after run_id are ignored.
    line_no increases with the place in the input."""
    df = _need(_lines(spark, path), 6)
    return df.select(_f(0).alias("qid"), _f(2).alias("docno"), F.col("f")[3].try_cast("int").alias("rank"), _f(4, "float").alias("sim"), _f(5).alias("run_id"), F.monotonically_increasing_id().alias("line_no"))


def read_qrels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``qid, docno, rel`` of 4-column judgments."""
    return _need(_lines(spark, path), 4, 4).select(_f(0).alias("qid"), _f(2).alias("docno"), _f(3, "int").alias("rel"))


def read_qrels_jg(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``qid, jg, docno, rel`` of judgments with a group in the second column."""
    return _need(_lines(spark, path), 4, 4).select(_f(0).alias("qid"), _f(1).alias("jg"), _f(2).alias("docno"), _f(3, "int").alias("rel"))


def read_prefs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``qid, jg, jsg, docno, level float`` of preference judgments."""
    return _need(_lines(spark, path), 5, 5).select(_f(0).alias("qid"), _f(1).alias("jg"), _f(2).alias("jsg"), _f(3).alias("docno"), _f(4, "float").alias("level"))


def read_qrels_as_prefs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """4-column judgments as preferences: the second column is the judgment group, the subgroup is '0'."""
    return read_qrels_jg(spark, path).select("qid", "jg", F.lit("0").alias("jsg"), "docno", F.col("rel").cast("float").alias("level"))


def read_zscores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``qid, measure, mean, stddev``."""
    return _need(_lines(spark, path), 4, 4).select(_f(0).alias("qid"), _f(1).alias("measure"), _f(2, "double").alias("mean"), _f(3, "double").alias("stddev"))


def read_result4(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``qid, doc_id, score`` of the search tool's 4-column results."""
    return _need(_lines(spark, path), 4).select(_f(0).alias("qid"), _f(2).alias("doc_id"), _f(3, "double").alias("score"))


def read_engine_ranks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines ``label qid:Q e:r e:NULL ... #docid = D inc = I prob = P`` as ``label, qid, ranks map<int,int>, doc_id,
    inc, prob, seq``; NULL ranks become null, seq increases with the place in the input."""
    v = F.col("value")
    body = F.regexp_extract(v, r"qid:\S+\s+([^#]*)", 1)
    entries = F.filter(F.split(F.trim(body), r"\s+"), lambda e: e.contains(":"))
    engine = lambda e: F.split(e, ":")[0].cast("int")
    rank = lambda e: F.split(e, ":")[1].try_cast("int")
    comment = lambda name: F.regexp_extract(v, rf"{name}\s*=\s*(\S+)", 1)
    return spark.read.text(path).where(F.trim("value") != "").select(
        F.regexp_extract(v, r"^\s*(-?\d+)", 1).cast("int").alias("label"), F.regexp_extract(v, r"qid:(\S+)", 1).cast("int").alias("qid"),
        F.map_from_arrays(F.transform(entries, engine), F.transform(entries, rank)).alias("ranks"), comment("docid").alias("doc_id"),
        comment("inc").try_cast("double").alias("inc"), comment("prob").try_cast("double").alias("prob"), F.monotonically_increasing_id().alias("seq"),
    )


def run_lines(run: DataFrame, tag: str, score_format: str = "%.4f", qid: str = "qid", doc: str = "doc_id", rank: str = "rank", score: str = "score") -> DataFrame:
    """``value``: lines ``qid Q0 doc rank score tag``, ready for a text sink. An empty score_format writes the number as it is."""
    s = F.format_string(score_format, F.col(score)) if score_format else F.col(score).cast("string")
    return run.select(F.concat_ws(" ", F.col(qid).cast("string"), F.lit("Q0"), F.col(doc), F.col(rank).cast("string"), s, F.lit(tag)).alias("value"))


def search_lines(run: DataFrame) -> DataFrame:
    """``value``: the search tool's lines ``qid 0 doc score``."""
    return run.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), F.col("doc_id"), F.col("score").cast("string")).alias("value"))


def qrels_lines(ranks: DataFrame) -> DataFrame:
    """``value``: judgments out of an engine-rank table, per query by label descending, then by first appearance."""
    return ranks.orderBy("qid", F.desc("label"), "seq").select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), F.col("doc_id"), F.col("label").cast("string")).alias("value"))


def expansion_lines(terms: DataFrame) -> DataFrame:
    """``value``: lines ``qid: w1 w2 ...`` of a table ``qid, word, place``; as long as a query's expansion."""
    words = F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return terms.groupBy("qid").agg(words.alias("w")).select(F.concat(F.col("qid").cast("string"), F.lit(": "), F.array_join("w", " ")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
