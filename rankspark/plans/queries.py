"""Queries of the core package: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankspark.functions import codec, text
from rankspark.operators import bpe, evaluate, fusion, index, lm, measures, nested, packed, prefs as prefs_ops, search
from rankspark.operators.judge import EvalConfig, judge, rank_run
from rankspark.plans.stage import materialise, scratch, written
from rankspark.sources import corpus, trec
from rankspark.streaming import stats

DEPTH = 100  # fixed value: length of the result lists that are re-ranked
BPE_MERGES = 40  # parameter: merges that bpe_train learns
# Parameter: a small list of merges for the queries over byte-pair tokens.
GIVEN_MERGES = [tuple(m.split("+")) for m in "t+h th+e i+n e+r o+n a+n r+e e+n a+t in+g s+t o+r an+d e+s t+i ti+on i+s d+e c+o l+e o+u t+e a+l i+c r+o a+r".split()]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of all paragraphs and spans of articles: what the automaton's states accept and route to their tables."""
    return nested.shred_articles(table(spark, sf, "articles"), keys_only=True).select("article_id", "para_no", "span_no")


def _article_table(name: str, about: str) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return nested.article_tables(table(spark, sf, "articles"))[name]

    f.__name__, f.__doc__ = f"p3_{name}", about
    query(f)


_article_table("articles", "One row per readable payload.")
_article_table("paragraphs", "Every paragraph with its parent and its own fields.")
_article_table("spans", "Every span with its paragraph and its own fields.")
_article_table("shapes", "How often every state of the automaton occurs.")
_article_table("subtypes", "The subtypes the shapes are merged to, with their fields.")
_article_table("unreadable", "Payloads that give no rows, with the reason.")


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every path packed into the two file fields of metadata."""
    stand_ins = packed.stand_in_list(table(spark, sf, "stand_ins"))
    return packed.explode_packed(table(spark, sf, "metadata"), "row_id", ["pdf_json_files", "pmc_json_files"], stand_ins, "file_path")


# --- index and search: the topics are the queries, documents the collection -------------------------------------------


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topics").select(F.col("query_number").alias("qid"), "title", "description")


def _tf(spark: SparkSession, sf: str) -> DataFrame:
    return index.term_frequencies(table(spark, sf, "documents"))


def _n_docs(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "documents").select("doc_id").distinct().count()


@query
def tokens_tf(spark: SparkSession, sf: str) -> DataFrame:
    return _tf(spark, sf)


@query
def doc_len(spark: SparkSession, sf: str) -> DataFrame:
    return index.document_lengths(_tf(spark, sf))


@query
def df_idf(spark: SparkSession, sf: str) -> DataFrame:
    return index.document_frequencies(_tf(spark, sf), _n_docs(spark, sf)).withColumn("idf", F.round("idf", 6))


@query
def doc_norms(spark: SparkSession, sf: str) -> DataFrame:
    tf = materialise(_tf(spark, sf))
    return index.document_norms(tf, index.document_frequencies(tf, _n_docs(spark, sf))).withColumn("norm", F.round("norm", 5))


@query
def postings_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of every posting list with gaps in variable-byte form."""
    p = index.packed_postings(_tf(spark, sf), index.numbered_documents(table(spark, sf, "documents")))
    size = F.aggregate(F.transform("gaps", codec.encoded_bytes), F.lit(0), lambda a, x: a + x)
    return index.block_gaps(p).groupBy("term").agg(F.sum("n").alias("df"), F.sum(size).alias("gap_bytes"))


@query
def vbyte_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Posting lists (documents and counts) encoded and decoded again, with the bytes of both codecs."""
    docs = table(spark, sf, "documents")
    numbers = index.numbered_documents(docs)
    p = index.packed_postings(index.numbered_frequencies(docs, numbers), numbers)
    enc = index.block_gaps(p).withColumnRenamed("gaps", "ids").select("term", "ids", "tfs", codec.vbyte_encode("ids").alias("v"), codec.vbyte_encode("tfs").alias("w"), codec.fixed_encode("ids").alias("f"))
    enc = enc.withColumns({"v2": codec.vbyte_decode("v"), "w2": codec.vbyte_decode("w"), "f2": codec.fixed_decode("f"), "u": codec.ungaps("ids")})
    ascending = F.get("u", F.size("u") - 1) == F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    same = (F.col("v2") == F.col("ids")) & (F.col("f2") == F.col("ids")) & (F.col("w2") == F.col("tfs")) & ascending
    of = lambda c: F.sum(F.length(c)).cast("bigint")
    return enc.groupBy("term").agg(of("v").alias("gap_bytes"), of("w").alias("tf_bytes"), of("f").alias("fixed_bytes"), F.min(same).alias("same"))


@query
def encoded_index_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of the topics' title terms out of an index stored as variable-byte lists."""
    path = scratch(spark)
    index.write_index(path, table(spark, sf, "documents").select("doc_id", "text"), encoded="vbyte")
    return index.read_lists(spark, path, _title_terms(spark, sf))


@query
def stored_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary of a stored index."""
    path = scratch(spark)
    index.write_index(path, table(spark, sf, "documents").select("doc_id", "text"))
    return index.read_index(spark, path)["dictionary"].select("term", "df", F.round("idf", 6).alias("idf"))


@query
def stored_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 best documents per topic, from a stored index."""
    path = scratch(spark)
    index.write_index(path, table(spark, sf, "documents").select("doc_id", "text"))
    return search.search_index(spark, path, _topics(spark, sf), 100, digits=6)


def _given_merges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(GIVEN_MERGES)], "rank int, left string, right string")


@query
def tfidf_bpe_top100(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 best documents per topic from a stored index of byte-pair tokens, the merges given."""
    path = scratch(spark)
    index.write_index(path, table(spark, sf, "documents").select("doc_id", "text"), merges=_given_merges(spark))
    return search.search_index(spark, path, _topics(spark, sf), 100, digits=6)


@query
def tfidf_top100(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(table(spark, sf, "documents"), _topics(spark, sf), 100, digits=6)


@query
def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return search.query_terms(_topics(spark, sf), index.document_frequencies(_tf(spark, sf), _n_docs(spark, sf)))


@query
def tfidf_top10(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(table(spark, sf, "documents"), _topics(spark, sf), 10, digits=6)


def _title_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _topics(spark, sf).select(F.explode(text.index_tokens(F.col("title"))).alias("term")).distinct()


def _list_texts(spark: SparkSession, sf: str, results: DataFrame) -> DataFrame:
    """Texts of the documents that stand in a result list."""
    return table(spark, sf, "documents").select("doc_id", "text").join(results.select("doc_id").distinct(), "doc_id", "left_semi")


def _results(spark: SparkSession, sf: str, k: int = DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A result list per topic, counts of the re-ranking terms of its documents, and those of the topics' titles."""
    results = materialise(search.search(table(spark, sf, "documents"), _topics(spark, sf), k, digits=6))
    tf = materialise(lm.text_terms(_list_texts(spark, sf, results)).withColumnRenamed("n", "tf"))
    return results, tf, lm.text_terms(_topics(spark, sf), "qid", "title")


@query
def query_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return lm.query_likelihood(*_results(spark, sf)).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query
def rm1_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return lm.rm1_rerank(*_results(spark, sf)).select("qid", "doc_id", F.round("score", 6).alias("score"))


def _word_queries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every vector whose id is divisible by 20 as a query of that id, with the vectors of its label as local embedding
    (words are the vectors' ids): ``qid, word, vec`` and ``qid, term, n``. Ids divisible by 40 also ask for the label's
    next id, twice."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))
    following = F.lead("word").over(Window.partitionBy("label").orderBy("vec_id"))
    asked = e.withColumn("following", following).where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("qid"), "word", "following")
    second = F.when(F.col("qid") % 40 == 0, F.col("following"))
    words = F.array(F.struct(F.col("word").alias("term"), F.lit(1).alias("n")), F.struct(second.alias("term"), F.lit(2).alias("n")))
    terms = asked.select("qid", F.inline(words)).where("term is not null")
    vectors = lm.unit_vectors(e).join(asked.select("label", "qid"), "label").select("qid", "word", "vec")
    return vectors, terms


@query
def expansion_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest words to every query of _word_queries(), in its own embedding."""
    return lm.expansion_terms(*_word_queries(spark, sf)).select("qid", "word", F.round("sim", 6).alias("sim"), F.round("weight", 6).alias("weight"))


def _count_vectors(held: DataFrame) -> DataFrame:
    """``qid, word, vec``: counts of every term of ``qid, rank, term, tf`` by rank, as long as a result list."""
    vec = F.transform(F.sequence(F.lit(1), F.lit(DEPTH)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double"))
    return held.groupBy("qid", F.col("term").alias("word")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "tf"))).alias("m")).select("qid", "word", vec.alias("vec"))


@query
def expansion_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Result lists re-ranked with expanded queries; the embedding's words are the terms of the results, its vectors
    their counts over the whole list (a fixed stand-in for a trained embedding)."""
    results, tf, terms = _results(spark, sf)
    v = _count_vectors(results.select("qid", "doc_id", "rank").join(tf, "doc_id"))
    return lm.expansion_rerank(results, tf, terms, written(lm.unit_vectors(written(v)))).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query
def relevance_corpora(spark: SparkSession, sf: str) -> DataFrame:
    """What a topic's local embedding is trained on: the preprocessed texts of its result list."""
    results = materialise(search.search(table(spark, sf, "documents"), _topics(spark, sf), DEPTH, digits=6))
    return lm.relevance_corpus(results, _list_texts(spark, sf, results).withColumn("seg", F.lit(0)))


@query
def local_embedding_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Result lists re-ranked with queries expanded by an embedding trained on each topic's own list."""
    results, tf, terms = _results(spark, sf)
    corpora = materialise(lm.relevance_corpus(results, _list_texts(spark, sf, results).withColumn("seg", F.lit(0))))
    return lm.expansion_rerank(results, tf, terms, written(lm.local_embeddings(corpora))).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query
def preprocess_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.preprocess(F.col("text"), digits=True).alias("text"))


@query
def rerank_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the re-ranking tokenizer per document."""
    return table(spark, sf, "documents").select("doc_id", F.size(text.rerank_tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query
def mask_unprintable_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.mask_unprintable(F.col("text")).alias("text"))


@query
def title_and_content_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of what the index is built of: title, a blank and content."""
    d = table(spark, sf, "docstore").select("docid", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
    t = d.select("docid", F.explode(text.index_tokens(corpus.indexed_text())).alias("term"))
    return t.groupBy("docid", "term").agg(F.count(F.lit(1)).alias("tf"))


@query
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.histogram(table(spark, sf, "documents"), "n_chars")


@query
def bpe_train(spark: SparkSession, sf: str) -> DataFrame:
    """The first BPE_MERGES merges learnt from the texts of all documents."""
    merges = bpe.train(table(spark, sf, "documents"), BPE_MERGES)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string")


@query
def bpe_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens per document with the merges of bpe_train()."""
    words = bpe.encode_tokens(table(spark, sf, "documents").select("doc_id", "text"), bpe_train(spark, sf))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"))


@query
def bpe_merges_file(spark: SparkSession, sf: str) -> DataFrame:
    """Merges learnt from all documents, written to a file and read again."""
    path = scratch(spark)
    bpe.write_merges(spark, [(r.left, r.right) for r in bpe_train(spark, sf).orderBy("rank").collect()], path)
    return bpe.read_merges(spark, path)


# --- rank fusion: the multi-engine table -------------------------------------------------------------------------------


def _engines(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks below 1 are no ranks."""
    e = table(spark, sf, "engine_ranks")
    valid = F.transform_values("ranks", lambda k, v: F.when(v >= 1, v))
    return e.select("qid", "doc_id", valid.alias("ranks"), "label", F.col("row_id").alias("seq"))


def _fused(spark: SparkSession, sf: str, method: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return method(_engines(spark, sf)).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query
def rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, fusion.rrf)


@query
def borda(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, fusion.borda)


@query
def weighted_borda(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, fusion.weighted_borda)


@query
def condorcet(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.condorcet(_engines(spark, sf)).select("qid", "doc_id", "score", "rank")


@query
def bayes_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, fusion.bayes_fuse)


# --- evaluation: the fused run against the table's labels --------------------------------------------------------------


def _run(spark: SparkSession, sf: str) -> DataFrame:
    return rrf(spark, sf).select(F.col("qid").cast("string").alias("qid"), F.col("doc_id").alias("docno"), F.col("score").cast("float").alias("sim"), F.lit("rrf").alias("run_id"))


def _qrels(spark: SparkSession, sf: str) -> DataFrame:
    """A document's greatest label; without any it is in the pool but unjudged."""
    e = table(spark, sf, "engine_ranks")
    return e.groupBy(F.col("qid").cast("string").alias("qid"), F.col("doc_id").alias("docno")).agg(F.coalesce(F.max("label"), F.lit(-1)).alias("rel"))


def _evaluated(spark: SparkSession, sf: str, **cfg) -> DataFrame:
    out = evaluate.evaluate(_run(spark, sf), _qrels(spark, sf), EvalConfig(**cfg))
    return out.select("measure", "qid", F.round("value", 6).alias("value"), "text")


@query
def judged_run(spark: SparkSession, sf: str) -> DataFrame:
    return judge(_run(spark, sf), _qrels(spark, sf), EvalConfig()).select("qid", "docno", "r", "rel", "c", "nonrel_above", "pool_above")


@query
def eval_official(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf)


@query
def eval_all_trec(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf, measures=("all_trec", "yaap"))


@query
def eval_level2_judged_only(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf, level=2, judged_only=True, measures=("map", "P.5,10", "num_rel", "num_ret", "num_rel_ret"))


@query
def eval_complete_top20(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf, complete=True, max_docs=20, measures=("map", "P.5,10", "num_rel", "num_ret", "num_rel_ret", "recip_rank"))


@query
def eval_single_query(spark: SparkSession, sf: str) -> DataFrame:
    """One query alone: the one whose number is the first in the order of text."""
    first = table(spark, sf, "engine_ranks").agg(F.min(F.col("qid").cast("string"))).first()[0]
    return _evaluated(spark, sf, only_query=first, per_query=True, measures=("map", "P.5,10", "num_rel", "num_ret", "num_rel_ret", "num_q"))


GAINS = (1, 3.0), (2, 9.5)  # parameter: gains of the levels 1 and 2 in eval_gains


@query
def eval_gains(spark: SparkSession, sf: str) -> DataFrame:
    """nDCG of every query with gains of its own per level."""
    given = ",".join(f"{level}={gain}" for level, gain in GAINS)
    out = evaluate.evaluate(_run(spark, sf), _qrels(spark, sf), EvalConfig(measures=(f"ndcg.{given}",), per_query=True, summary=False))
    return out.select(F.lit("ndcg").alias("measure"), "qid", F.round("value", 6).alias("value"))


@query
def eval_zscores(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision of every query in standard deviations from a reference: the mean is its precision at 10, the
    deviation its share of relevant documents; where that is 0, and for queries without a reference (of even number), there is no score."""
    run, qrels = materialise(_run(spark, sf)), materialise(_qrels(spark, sf))
    p10 = evaluate.evaluate(run, qrels, EvalConfig(measures=("P.10", "set_P"), per_query=True, summary=False))
    z = p10.groupBy("qid").agg(F.max(F.when(F.col("measure") == "P_10", F.col("value"))).alias("mean"), F.max(F.when(F.col("measure") == "set_P", F.col("value"))).alias("stddev"))
    z = z.where("cast(qid as int) % 2 = 1").select("qid", F.lit("map").alias("measure"), "mean", "stddev")
    path = scratch(spark)
    trec.write_lines(z.select(F.concat_ws("\t", "qid", "measure", F.col("mean").cast("string"), F.col("stddev").cast("string")).alias("value")), path)
    out = evaluate.evaluate(run, qrels, EvalConfig(measures=("map",), per_query=True, summary=False), trec.read_zscores(spark, path))
    return out.select("measure", "qid", F.round("value", 5).alias("value"))


def _all_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every ranking of runs as a query (named by run and number), a document with its highest finite score; the level
    of a document is taken from its name, every seventh name being unjudged."""
    r = table(spark, sf, "runs").where("docno is not null and score is not null and run_id is not null and query_number is not null and abs(score) < double('infinity')")
    r = r.groupBy(F.concat_ws("/", "run_id", F.col("query_number").cast("string")).alias("qid"), "docno").agg(F.max("score").cast("float").alias("sim"))
    code = F.ascii(F.substring("docno", -1, 1)) + F.ascii(F.substring("docno", 1, 1))
    return r, r.select("qid", "docno", F.when(code % 7 == 0, -1).otherwise(F.greatest(code % 5 - 2, F.lit(0))).alias("rel"))


@query
def eval_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Official measures and nDCG over all rankings of all runs."""
    out = evaluate.evaluate(*_all_runs(spark, sf), EvalConfig(measures=("official", "ndcg")))
    return out.select("measure", "qid", F.round("value", 6).alias("value"), "text")


def _measure_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return _evaluated(spark, sf, measures=(name,), per_query=True, summary=False).select("measure", "qid", "value" if name != "relstring" else F.col("text").alias("value"))

    f.__name__ = f"m_{name}"
    f.__doc__ = f"{name} of every query."
    return f


for _name, _m in measures.REGISTRY.items():
    if not _name.startswith("prefs_") and not _name.endswith("_avgjg") and _name not in ("runid", "num_q") and _m.avg != "geo":
        query(_measure_query(_name))


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    """Judgments in two groups: by whether a document's first row has an odd number."""
    e = table(spark, sf, "engine_ranks")
    g = e.groupBy(F.col("qid").cast("string").alias("qid"), F.col("doc_id").alias("docno")).agg(F.coalesce(F.max("label"), F.lit(-1)).alias("rel"), (F.min("row_id") % 2).cast("string").alias("jg"))
    return g.select("qid", "jg", "docno", "rel")


@query
def eval_judgment_groups(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.evaluate(_run(spark, sf), _grouped(spark, sf), EvalConfig(measures=("qrels_jg",), per_query=True, summary=False))
    return out.select("measure", "qid", F.round("value", 6).alias("value"))


def _preferences(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    """Preference measures, the labels taken as levels."""
    p = _grouped(spark, sf).select("qid", "jg", F.lit("0").alias("jsg"), "docno", F.col("rel").cast("float").alias("level"))
    out = evaluate.evaluate(_run(spark, sf), p, EvalConfig(measures=tuple(names), per_query=True, summary=False))
    return out.select("measure", "qid", F.round("value", 6).alias("value"))


@query
def eval_preferences(spark: SparkSession, sf: str) -> DataFrame:
    return _preferences(spark, sf, [m for m in measures.NICKNAMES["all_prefs"][2:] if "Rnonrel" not in m])


@query
def eval_preferences_recounted(spark: SparkSession, sf: str) -> DataFrame:
    return _preferences(spark, sf, [m for m in measures.NICKNAMES["all_prefs"] if "Rnonrel" in m])


@query
def preference_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = _grouped(spark, sf).select("qid", "jg", F.lit("0").alias("jsg"), "docno", F.col("rel").cast("float").alias("level"))
    return prefs_ops.preference_pairs(p)[0].groupBy("qid", "jg").agg(F.count(F.lit(1)).alias("pairs"))


def _subgroups(spark: SparkSession, sf: str) -> DataFrame:
    """Preferences of two overlapping subgroups per query: by a document's first row, a third of the documents stands in
    the first, a third in the second, and a third in both."""
    e = table(spark, sf, "engine_ranks")
    g = e.groupBy(F.col("qid").cast("string").alias("qid"), F.col("doc_id").alias("docno")).agg(F.coalesce(F.max("label"), F.lit(-1)).cast("float").alias("level"), (F.min("row_id") % 3).alias("k"))
    both = F.when(F.col("k") == 0, F.array(F.lit("0"))).when(F.col("k") == 1, F.array(F.lit("1"))).otherwise(F.array(F.lit("0"), F.lit("1")))
    return g.select("qid", F.lit("g").alias("jg"), F.explode(both).alias("jsg"), "docno", "level")


@query
def preference_closure_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the transitive closure over two subgroups."""
    return prefs_ops.preference_pairs(_subgroups(spark, sf))[0].groupBy("qid", "jg").agg(F.count(F.lit(1)).alias("pairs"))


@query
def eval_preference_subgroups(spark: SparkSession, sf: str) -> DataFrame:
    """Preference measures over the closure of two subgroups."""
    names = tuple(m for m in measures.NICKNAMES["all_prefs"][2:] if "Rnonrel" not in m)
    out = evaluate.evaluate(_run(spark, sf), _subgroups(spark, sf), EvalConfig(measures=names, per_query=True, summary=False))
    return out.select("measure", "qid", F.round("value", 6).alias("value"))


@query
def correct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.correct_counts(_run(spark, sf), _qrels(spark, sf))


@query
def mean_f1(spark: SparkSession, sf: str) -> DataFrame:
    r = rank_run(_run(spark, sf))
    return evaluate.mean_f1(r, _qrels(spark, sf)).select("qid", F.round("f1", 6).alias("f1"))


@query
def mean_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    q = _qrels(spark, sf).where("rel >= 0")
    out = evaluate.mean_ndcg(rank_run(_run(spark, sf)), q)
    return out.select("qid", *[F.round(f"ndcg_{k}", 6).alias(f"ndcg_{k}") for k in (5, 10, 50)])


@query
def report(spark: SparkSession, sf: str) -> DataFrame:
    """The printed form of the official measures."""
    return evaluate.report_lines(evaluate.evaluate(_run(spark, sf), _qrels(spark, sf)).withColumn("value", F.round("value", 12)))


@query
def run_file_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the fused run, scores with four decimals."""
    return trec.run_lines(fusion.rrf(_engines(spark, sf), digits=12), "rrf")


# --- files: tables written in a format of the evaluation tools and read again -----------------------------------------


def _again(spark: SparkSession, lines: DataFrame, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    path = scratch(spark)
    trec.write_lines(lines, path)
    return read(spark, path)


def _line(*cols: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.dropna(subset=list(cols)).select(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]).alias("value"))


@query
def run_file(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of runs as a ranking file; rows with a null can't stand in one."""
    lines = table(spark, sf, "runs").dropna(subset=["query_number", "docno", "rank", "score", "run_id"]).select(F.concat_ws(" ", F.col("query_number").cast("string"), F.lit("Q0"), "docno", F.col("rank").cast("string"), F.format_string("%.4f", "score"), "run_id").alias("value"))
    return _again(spark, lines.where("value not like '% NaN %' and value not like '%Infinity %'"), trec.read_run).select("qid", "docno", "rank", F.round(F.col("sim").cast("double"), 2).alias("sim"), "run_id")


@query
def qrels_file(spark: SparkSession, sf: str) -> DataFrame:
    """Judgments of engine_ranks, by label descending per query."""
    ranks = table(spark, sf, "engine_ranks").where("label is not null and qid is not null and doc_id is not null").withColumnRenamed("row_id", "seq")
    return _again(spark, trec.qrels_lines(ranks), trec.read_qrels)


@query
def qrels_groups_file(spark: SparkSession, sf: str) -> DataFrame:
    return _again(spark, _line("qid", "jg", "docno", "rel")(_grouped(spark, sf)), trec.read_qrels_jg)


@query
def qrels_as_preferences_file(spark: SparkSession, sf: str) -> DataFrame:
    return _again(spark, _line("qid", "jg", "docno", "rel")(_grouped(spark, sf)), trec.read_qrels_as_prefs)


@query
def preferences_file(spark: SparkSession, sf: str) -> DataFrame:
    return _again(spark, _line("qid", "jg", "jsg", "docno", "level")(_subgroups(spark, sf)), trec.read_prefs)


@query
def result4_file(spark: SparkSession, sf: str) -> DataFrame:
    """Search results in their four-column form."""
    top = search.search(table(spark, sf, "documents"), _topics(spark, sf), 10, digits=4)
    return _again(spark, trec.search_lines(top.withColumn("doc_id", F.col("doc_id").cast("string"))), trec.read_result4)


@query
def engine_ranks_file(spark: SparkSession, sf: str) -> DataFrame:
    """The multi-engine table as its lines: ``label, qid, doc_id, engine, rank, inc, prob``, a row per engine named."""
    e = table(spark, sf, "engine_ranks").dropna(subset=["label", "qid", "doc_id"]).where("size(ranks) > 0")
    ranks = F.array_join(F.transform(F.map_entries("ranks"), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), F.coalesce(x["value"].cast("string"), F.lit("NULL")))), " ")
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    value = F.concat(F.col("label").cast("string"), F.lit(" qid:"), F.col("qid").cast("string"), F.lit(" "), ranks, F.lit(" #docid = "), "doc_id", F.lit(" inc = "), given("inc"), F.lit(" prob = "), given("prob"))
    back = _again(spark, e.select(value.alias("value")), trec.read_engine_ranks)
    return back.select("label", "qid", "doc_id", F.explode("ranks").alias("engine", "rank"), "inc", "prob")


@query
def topics_file(spark: SparkSession, sf: str) -> DataFrame:
    """Topics as blocks of tags."""
    given = lambda c: F.coalesce(c, F.lit(""))
    block = F.concat(F.lit("<top>\n<num> Number: "), F.col("query_number").cast("string"), F.lit("\n<title> "), given("title"), F.lit("\n<desc> Description:\n"), given("description"), F.lit("\n<narr> Narrative:\n"), given("narrative"), F.lit("\n</top>\n"))
    return _again(spark, table(spark, sf, "topics").select(block.alias("value")), corpus.read_topics)


@query
def xml_topics_file(spark: SparkSession, sf: str) -> DataFrame:
    """Topics as XML elements."""
    path = scratch(spark)
    t = table(spark, sf, "topics").select(F.col("query_number").alias("_number"), F.col("title").alias("query"), F.col("description").alias("question"), "narrative")
    t.write.format("xml").option("rowTag", "topic").option("rootTag", "topics").save(path)
    return corpus.read_xml_topics(spark, path)


@query
def xml_documents_file(spark: SparkSession, sf: str) -> DataFrame:
    """The docstore as XML documents; white space within texts is brought to single blanks."""
    path = scratch(spark)
    plain = lambda c: text.trim_ws(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Cc}]+", " "))
    d = table(spark, sf, "docstore").select(F.col("docid").alias("DOCID"), plain("title").alias("TITLE"), plain("content").alias("CONTENT"))
    d.write.format("xml").option("rowTag", "DOC").option("rootTag", "DATA").save(path)
    return corpus.read_xml_documents(spark, path, names="part-*")


@query
def metadata_file(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata as CSV, read for the documents of the docstore; files per list."""
    path, m = scratch(spark), table(spark, sf, "metadata")
    m.select("cord_uid", "title", "abstract", "pdf_json_files", "pmc_json_files").write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = corpus.read_metadata(spark, path, wanted=table(spark, sf, "docstore").select(F.col("docid").alias("cord_uid")))
    return back.select("cord_uid", F.coalesce("title", F.lit("")).alias("title"), F.size("pdf_files").alias("pdf_files"), F.size("pmc_files").alias("pmc_files"))


@query
def article_files(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of article files, one file per topic with its three texts."""
    path = scratch(spark)
    body = F.array(*[F.struct(F.col(c).alias("text")) for c in ("title", "description", "narrative")]).alias("body_text")
    table(spark, sf, "topics").select("query_number", body).write.partitionBy("query_number").json(path)
    back = corpus.read_article_bodies(spark, f"{path}/*")
    return back.select(F.regexp_extract("file", r"query_number=(\d+)", 1).cast("int").alias("query_number"), "seg", "text")


@query
def embeddings_file(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as text with a header line, brought to length 1: ``word, first`` and ``last`` number."""
    e = table(spark, sf, "embeddings").select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))
    head = e.sparkSession.createDataFrame([("0 0",)], "value string")
    v = _again(spark, head.unionByName(e), corpus.read_embeddings)
    return v.select("word", F.round(F.get("vec", F.lit(0)), 5).alias("first"), F.round(F.element_at("vec", -1), 5).alias("last"))


@query
def expansion_file_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the ten nearest words to every query of _word_queries()."""
    return trec.expansion_lines(lm.expansion_terms(*_word_queries(spark, sf)))


@query
def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every second source and of those every fifth document."""
    d = table(spark, sf, "documents").where("source is not null")
    return corpus.training_sample(d.select(F.col("source").alias("file"), "doc_id"))


@query
def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    return stats.windowed_counts(table(spark, sf, "events"))
