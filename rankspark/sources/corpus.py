"""Readers of document collections, topics, metadata, articles and embeddings. Schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rankspark.functions.text import trim_ws
from rankspark.operators.lm import unit_vectors
from rankspark.operators.positions import largest_group, running
from rankspark.plans.stage import numbered


def read_xml_documents(spark: SparkSession, path: str | list[str], recursive: bool = False, names: str | None = None) -> DataFrame:
    """``doc_id, title, content`` of every DOC element; missing children are empty; unreadable files give no rows. Only
    files whose name fits the glob pattern ``names`` are read, if one is given."""
    r = spark.read if names is None else spark.read.option("pathGlobFilter", names)
    r = r.format("xml").option("rowTag", "DOC").option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", str(recursive).lower())
    df = r.schema("DOCID string, TITLE string, CONTENT string").load(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(n) for c, n in (("DOCID", "doc_id"), ("TITLE", "title"), ("CONTENT", "content"))])


def indexed_text() -> Column:
    """What the index is built of: title, a blank, content."""
    return F.concat_ws(" ", "title", "content")


def training_sample(files: DataFrame, file: str = "file", doc_id: str = "doc_id") -> DataFrame:
    """Every second file and of those every fifth document, by the order of their names: the same rows each time."""
    ordered = files.select(file).distinct().repartitionByRange(file).sortWithinPartitions(file)
    kept = files.join(numbered(ordered, "_f").where("_f % 2 = 0"), file)
    placed = running(kept, [file], [F.col(doc_id).asc()], {"_d": F.lit(1)}, largest_group(kept.select(file), [file]))
    return placed.where("_d % 5 = 1").drop("_f", "_d")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """``qid, title, description`` of topic blocks: <top>, <num> Number:, <title>, <desc>, <narr>."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<top>(.*?)</top>"), F.lit(1))).alias("b"))
    part = lambda tag, lead="": trim_ws(F.regexp_extract("b", rf"(?s)<{tag}>\s*{lead}(.*?)(?=</?(?:top|num|title|desc|narr)>|$)", 1))
    return blocks.select(F.regexp_extract("b", r"<num>\s*Number:\s*(\d+)", 1).try_cast("int").alias("qid"), part("title").alias("title"), part("desc", r"(?:Description:)?\s*").alias("description"))


def read_xml_topics(spark: SparkSession, path: str) -> DataFrame:
    """``qid, query, question, narrative`` of topic elements."""
    df = spark.read.format("xml").option("rowTag", "topic").schema("_number bigint, query string, question string, narrative string").load(path)
    return df.select(F.col("_number").cast("int").alias("qid"), "query", "question", "narrative")


def read_metadata(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """``cord_uid, title, abstract, pdf_files, pmc_files`` of the metadata CSV: file lists are split at semicolons and
    keep what contains json. With ``wanted`` (cord_uid) only those rows."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    files = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x.contains("json"))
    out = df.select("cord_uid", "title", "abstract", files(F.col("pdf_json_files")).alias("pdf_files"), files(F.col("pmc_json_files")).alias("pmc_files"))
    return out if wanted is None else out.join(wanted.select("cord_uid").distinct(), "cord_uid", "left_semi")


def read_article_bodies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, seg, text``: the paragraphs of article JSON files; unreadable files give no rows."""
    df = spark.read.schema("body_text array<struct<text: string>>").option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    return df.select("file", F.posexplode("body_text").alias("seg", "p")).select("file", "seg", "p.text")


def document_texts(metadata: DataFrame, bodies: DataFrame) -> DataFrame:
    """``cord_uid, seg, text`` of metadata rows: the paragraphs of the PDF parses where a row lists any, else of the
    other parses, else abstract, then title. ``bodies`` has a ``file`` as the lists name it."""
    has = lambda c: F.size(c) > 0
    files = F.when(has("pdf_files"), F.col("pdf_files")).otherwise(F.col("pmc_files"))
    listed = metadata.withColumn("_row", F.monotonically_increasing_id()).select("cord_uid", "_row", F.posexplode(files).alias("_k", "file")).join(bodies, "file")
    w = Window.partitionBy("cord_uid").orderBy("_row", "_k", "seg")
    parsed = listed.select("cord_uid", F.row_number().over(w).alias("seg"), "text")
    plain = metadata.where(~has("pdf_files") & ~has("pmc_files")).select("cord_uid", F.posexplode(F.array("abstract", "title")).alias("seg", "text"))
    return parsed.unionByName(plain)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """``word, vec`` of a text embedding with a header line; vectors are brought to length 1."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(f) > 2).select(f[0].alias("word"), F.transform(F.slice(f, F.lit(2), F.size(f)), lambda x: x.cast("double")).alias("vec"))
    return unit_vectors(rows)
