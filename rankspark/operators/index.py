"""Inverted index as tables: postings, dictionary and document norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rankspark.functions import codec
from rankspark.functions.text import index_tokens
from rankspark.operators.bpe import encode_tokens
from rankspark.plans.stage import maybe_broadcast, numbered, written


BLOCK = 1 << 16  # documents a packed posting list is cut after


def idf(n_docs: Column, df: Column) -> Column:
    return F.log2(F.lit(1.0) + n_docs / df)


def tf_weight(tf: Column) -> Column:
    return F.when(tf > 0, F.lit(1.0) + F.log2(tf)).otherwise(0.0)


def term_frequencies(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text", merges: DataFrame | None = None) -> DataFrame:
    """``doc_id, term, tf``; with ``merges`` terms are byte-pair tokens, else index tokens. Null texts have no terms."""
    if merges is None:
        words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(index_tokens(F.col(text) if isinstance(text, str) else text)).alias("term"))
    else:
        words = encode_tokens(docs.select(F.col(doc_id).alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text")), merges)
    return words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def numbered_frequencies(docs: DataFrame, numbers: DataFrame, doc_id: str = "doc_id", text: str | Column = "text", merges: DataFrame | None = None) -> DataFrame:
    """``doc_id, doc_idx, term, tf``. The texts meet their numbers before they are cut into terms: there are far fewer of
    them, and a document's terms are then counted where it is. Texts without an identifier keep their terms and have no number."""
    if merges is not None:
        return term_frequencies(docs, doc_id, text, merges).join(numbers, "doc_id", "left").select("doc_id", "doc_idx", "term", "tf")
    d = docs.select(F.col(doc_id).alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text")).join(numbers, "doc_id", "left")
    words = d.select("doc_id", "doc_idx", F.explode(index_tokens(F.col("text"))).alias("term"))
    return words.groupBy("doc_id", "doc_idx", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, idf``."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf(F.lit(float(n_docs)), F.col("df")))


def document_lengths(tf: DataFrame) -> DataFrame:
    """``doc_id, length``: tokens per document."""
    return tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))


def document_norms(tf: DataFrame, df: DataFrame) -> DataFrame:
    """``doc_id, norm``: length of the vector of idf x tf."""
    return tf.join(df, "term").groupBy("doc_id").agg(F.sqrt(F.sum((F.col("idf") * F.col("tf")) * (F.col("idf") * F.col("tf")))).alias("norm"))


def packed_postings(tf: DataFrame, doc_idx: DataFrame, block: int = BLOCK) -> DataFrame:
    """``term, block, n, before, postings array<struct<doc_idx, tf>>``: posting lists with ascending documents, cut where doc_idx passes a multiple
    of ``block``, so that no row is longer than that; ``before`` is the last document of the term's earlier blocks (0 at
    the start). Searches use the long form. A ``tf`` of numbered_frequencies() brings its numbers along. Postings move
    once, by term, which both the blocks and what stands before them follow."""
    j = (tf if "doc_idx" in tf.columns else tf.join(doc_idx, "doc_id")).select("term", "doc_idx", "tf").where("doc_idx is not null").repartition("term")
    j = j.withColumn("block", F.floor(F.col("doc_idx") / block).cast("bigint"))
    p = j.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("doc_idx", "tf"))).alias("postings"))
    before = F.lag(F.element_at("postings", -1)["doc_idx"], 1, 0).over(Window.partitionBy("term").orderBy("block"))
    return p.select("term", "block", "n", before.alias("before"), "postings")


def block_gaps(packed: DataFrame) -> DataFrame:
    """``term, block, n, gaps, tfs`` of packed_postings(): what each document is after the one before it in the term's list."""
    return packed.select("term", "block", "n", codec.gaps(F.col("postings.doc_idx"), F.col("before")).alias("gaps"), F.col("postings.tf").alias("tfs"))


def encoded_postings(packed: DataFrame, compressed: bool = True) -> DataFrame:
    """``term, block, n, bytes``: the blocks of packed_postings() as bytes, document and count by turns: 4 bytes each, or
    gaps and counts in variable-byte form. The blocks of a term one after another are the term's list."""
    numbers = block_gaps(packed) if compressed else packed.select("term", "block", "n", F.col("postings.doc_idx").alias("gaps"), F.col("postings.tf").alias("tfs"))
    turns = F.flatten(F.zip_with("gaps", "tfs", lambda i, n: F.array(i, n)))
    return numbers.select("term", "block", "n", (codec.vbyte_encode if compressed else codec.fixed_encode)(turns).alias("bytes"))


def decoded_postings(encoded: DataFrame, compressed: bool = True) -> DataFrame:
    """``term, doc_idx, tf`` out of encoded_postings(). A compressed block needs the last document of the blocks before
    it, which is the sum of their gaps."""
    numbers = encoded.select("term", "block", "n", (codec.vbyte_decode if compressed else codec.fixed_decode)("bytes").alias("x"))
    places = F.sequence(F.lit(0), F.col("n").cast("int") - 1)
    d = numbers.select("term", "block", F.transform(places, lambda i: F.get("x", 2 * i)).alias("ids"), F.transform(places, lambda i: F.get("x", 2 * i + 1)).alias("tfs"))
    if compressed:
        d = d.withColumn("ids", codec.ungaps("ids"))
        w = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.element_at("ids", -1)).over(w), F.lit(0))
        d = d.withColumn("before", before).withColumn("ids", F.transform("ids", lambda i: i + F.col("before")))
    return d.select("term", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select("term", F.col("p.ids").alias("doc_idx"), F.col("p.tfs").alias("tf"))


def numbered_documents(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, doc_idx``: distinct documents numbered from 0 in the order of their id, by a range-partitioned sort."""
    d = docs.select(F.col(doc_id).alias("doc_id")).where("doc_id is not null").distinct()
    return numbered(d.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), "doc_idx")


def write_index(path: str, docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text", partitions: int | None = None, merges: DataFrame | None = None, encoded: str | None = None) -> None:
    """Tables ``postings`` (range-partitioned and sorted by term, so that a term's rows are found by the file
    statistics), ``dictionary``, ``norms`` and ``config`` under ``path``; with ``merges`` of byte-pair tokens, which are
    stored too. ``encoded`` ('fixed' or 'vbyte') adds the lists as bytes with the documents' numbers."""
    spark = docs.sparkSession
    tf_path = f"{path}/postings"
    if merges is not None:
        merges.select("rank", "left", "right").write.mode("overwrite").parquet(f"{path}/merges")
        merges = spark.read.parquet(f"{path}/merges")
    if encoded:
        numbered_documents(docs, doc_id).write.mode("overwrite").parquet(f"{path}/documents")
        numbers = spark.read.parquet(f"{path}/documents")
        with_idx = written(numbered_frequencies(docs, numbers, doc_id, text, merges).sortWithinPartitions("term", "doc_id"))
        tf = with_idx.select("doc_id", "term", "tf")
    else:
        tf = term_frequencies(docs, doc_id, text, merges)
    by = (partitions, "term") if partitions else ("term",)
    tf.repartitionByRange(*by).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(tf_path)
    tf = spark.read.parquet(tf_path)
    n = docs.select(doc_id).where(F.col(doc_id).isNotNull()).distinct().count()
    document_frequencies(tf, n).sort("term").write.mode("overwrite").parquet(f"{path}/dictionary")
    document_norms(tf, spark.read.parquet(f"{path}/dictionary")).write.mode("overwrite").parquet(f"{path}/norms")
    if encoded:
        lists = written(encoded_postings(packed_postings(with_idx, numbers), encoded == "vbyte"))  # else the sampling of the ranges encodes them once more
        lists.repartitionByRange(*by).sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/lists")
    config = [(n, "index_tokens" if merges is None else "byte_pairs", encoded)]
    spark.createDataFrame(config, "n_docs bigint, tokenizer string, lists string").write.mode("overwrite").parquet(f"{path}/config")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of write_index(); ``merges`` if it has any, and of encoded lists ``lists`` and ``documents``."""
    config = spark.read.parquet(f"{path}/config")
    kind = config.first()
    more = (["merges"] if kind.tokenizer == "byte_pairs" else []) + (["lists", "documents"] if kind.lists else [])
    return {"config": config} | {t: spark.read.parquet(f"{path}/{t}") for t in ("postings", "dictionary", "norms", *more)}


def read_lists(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """``doc_id, term, tf`` of the given terms out of the encoded lists of an index."""
    t = read_index(spark, path)
    lists = t["lists"].join(maybe_broadcast(terms.select("term").distinct()), "term")
    return decoded_postings(lists, t["config"].first().lists == "vbyte").join(t["documents"], "doc_idx").select("doc_id", "term", "tf")


def postings_of(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given terms; the terms go to the postings if they are few."""
    return postings.join(maybe_broadcast(terms.select("term").distinct()), "term")
