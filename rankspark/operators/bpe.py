"""Byte-pair tokens: encoding with an ordered list of merges, and training of one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankspark.functions.text import index_tokens
from rankspark.plans.stage import written

MAX_MERGES = 1_000_000


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """``rank, left, right`` of a merges file with two columns a line, in file order. Bytes are read as Latin-1."""
    whole = spark.read.format("binaryFile").load(path).select(F.decode("content", "ISO-8859-1").alias("value"))
    each = whole.select(F.posexplode(F.split("value", "\n")).alias("rank", "l")).where("l like '% %'")
    return each.select("rank", F.split("l", " ")[0].alias("left"), F.split("l", " ")[1].alias("right"))


def write_merges(spark: SparkSession, merges: list[tuple[str, str]], path: str) -> None:
    """One text file of two columns a line, in order; the bytes behind the Latin-1 text are written."""
    text = "".join(f"{a} {b}\n" for a, b in merges)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("latin-1")))
    finally:
        out.close()


def merge_parts(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The parts of a word after the merges, which apply in the order of their ranks, each once: a pair that only arises
    after its turn stays."""
    done = -1
    while len(parts) > 1:
        best = min((k for k in (ranks.get(p) for p in zip(parts, parts[1:], strict=False)) if k is not None and k > done), default=None)
        if best is None:
            break
        out: list[str] = []
        i = 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts, done = out, best
    return parts


def encode_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Tokens of a word as Latin-1 text of its UTF-8 bytes, after the merges."""
    return merge_parts(list(word.encode("utf-8").decode("latin-1")), ranks)


def encode_words(words: DataFrame, merges: DataFrame) -> DataFrame:
    """``word, tokens array<string>`` of distinct words. The merge list is a model of checked size and goes to every task."""
    rows = merges.select("rank", "left", "right").limit(MAX_MERGES + 1).collect()
    if len(rows) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} merges")
    shared = words.sparkSession.sparkContext.broadcast({(r.left, r.right): r.rank for r in sorted(rows, key=lambda r: -r.rank)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(tokens=[encode_word(w, shared.value) for w in pdf["word"]])

    return words.select("word").distinct().mapInPandas(run, "word string, tokens array<string>")


def encode_tokens(docs: DataFrame, merges: DataFrame) -> DataFrame:
    """``doc_id, term``: one row per byte-pair token of ``doc_id, text``. Distinct words are encoded once and joined back."""
    words = docs.select("doc_id", F.explode(index_tokens(F.col("text"))).alias("word"))
    counted = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    enc = encode_words(counted, merges)
    repeated = F.flatten(F.array_repeat("tokens", F.col("n").cast("int")))
    return counted.join(enc, "word").select("doc_id", F.explode(repeated).alias("term"))


def next_merges(top: list[tuple[str, str, int]], complete: bool, made: set[str]) -> list[tuple[str, str]]:
    """The first pairs of ``top`` (by count descending, then left, right) that one-at-a-time training would take too.

    Merging (a, b) changes the counts of pairs with a or b only, and makes pairs that are at most as frequent as a pair
    with a or b was. So pairs follow each other as long as none shares a part with one before it and their counts are
    above that of the first pair that does (``complete``: or of all that ``top`` doesn't show). What merges equal parts,
    or makes a token that was ``made`` before, ends the batch, as it changes counts beyond that.
    """
    taken: list[tuple[str, str, int]] = []
    used: set[str] = set()
    bar = None if complete or not top else top[-1][2]
    for left, right, n in top:
        if left in used or right in used:
            bar = n
            break
        taken.append((left, right, n))
        used |= {left, right, left + right}
        if left == right or left + right in made:
            break
    return [(a, b) for i, (a, b, n) in enumerate(taken) if i == 0 or bar is None or n > bar]


def train(docs: DataFrame, iterations: int, initial: list[tuple[str, str]] | None = None, text: str = "text", batch: int = 1000) -> list[tuple[str, str]]:
    """Merges learnt from the words of ``text``: each time the pair of greatest count over all words is merged, ties
    by left, then right. Counting runs in Spark on the distinct words, with sums per task before the shuffle; the
    ``batch`` most frequent pairs come to the driver, and as many of them are merged at once as one-at-a-time training
    would take in a row. Words reduced to one token are let go."""
    words = docs.select(F.explode(index_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    merges = list(initial or [])
    made = {a + b for a, b in merges}

    def merged(ranks: dict[tuple[str, str], int], column: str, start):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                parts = [merge_parts(start(w), ranks) for w in pdf[column]]
                yield pd.DataFrame({"parts": parts, "n": pdf["n"]})[[len(p) > 1 for p in parts]]

        return run

    def pairs(ranks: dict[tuple[str, str], int]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts: Counter[tuple[str, str]] = Counter()
            for pdf in batches:
                for p, n in zip(pdf["parts"], pdf["n"].tolist(), strict=True):
                    parts = merge_parts(list(p), ranks) if ranks else list(p)
                    for pair in zip(parts, parts[1:], strict=False):
                        counts[pair] += n
            yield pd.DataFrame({"l": [a for a, _ in counts], "r": [b for _, b in counts], "n": list(counts.values())}, columns=["l", "r", "n"])

        return run

    kind = "parts array<string>, n bigint"
    state = written(words.mapInPandas(merged({p: i for i, p in enumerate(merges)}, "word", lambda w: list(w.encode("utf-8").decode("latin-1"))), kind))
    goal, stored, passes = len(merges) + iterations, len(merges), 0
    while len(merges) < goal:
        ranks = {p: i for i, p in enumerate(merges[stored:])}
        top = state.mapInPandas(pairs(ranks), "l string, r string, n bigint").groupBy("l", "r").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "l", "r").limit(batch).collect()
        new = next_merges([(r.l, r.r, r.n) for r in top], len(top) < batch, made)[: goal - len(merges)]
        if not new:
            break
        merges += new
        made |= {a + b for a, b in new}
        passes += 1
        if passes % 8 == 0:
            state = written(state.mapInPandas(merged({p: i for i, p in enumerate(merges[stored:])}, "parts", list), kind))
            stored = len(merges)
    return merges
