"""Long exact spans shared between records.

Method: compaction of a de Bruijn graph whose tokens are characters. An edge is a k-mer of as many characters as a
shared span must have at least, from the node of its first k - 1 characters to that of its last k - 1. Only edges that
can repeat are built: every stretch of k characters holds a sampled fingerprint (the least hash of its shorter
windows), which any record with the same stretch samples too, so edges are built around fingerprints that stand in
several records, and nowhere else. Repeated edges carry the set of records they occur in (their colour). A node with
one repeated edge in and one out doesn't branch; a path through such nodes is compacted, as far as its colour stays, to
its first edge, by joining the edges with the nodes they start from: going on along it neither adds nor loses a record.
The first edges are joined with their source coordinates, the spans are read there and compared as text, and records
that have one in common are linked.

Edges, nodes and colours are known by their hashes. Edges that agree in both hashes by chance are told apart by their
text; nodes that do branch, which only means more first edges. A colour is the xor of 64-bit hashes of its records: two
edges in a row of different colours that agree in it and in their number of records (2^-64 for each) would lose one.

Exact copies of a text are one class with one representative from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from rankspark.plans.stage import materialise, maybe_broadcast, maybe_in, written

SPAN, GRAM = 160, 64
CHUNK = 1 << 18  # characters hashed at once; longer texts go in overlapping pieces
BLOCK = 512
# Odd multipliers of the two rolling hashes, and the constants of a 64-bit finaliser.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 12, 2 * len(have[0]) if have else 0)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        have = _powers[base] = (made[0], made[1])
    return have


def polynomials(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """The sum of mixed code x base^place over every window of ``width`` codes, modulo 2^64."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(base, len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mixed_codes(codes, base) * up[: len(codes)], out=total[1:])
    return (total[width:] - total[:n]) * down[:n]


def _mixed_codes(codes: np.ndarray, base: int) -> np.ndarray:
    return _mix(codes + np.uint64(base >> 32))


def rolling(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` codes; equal windows have equal hashes wherever they stand."""
    return _mix(polynomials(codes, width, base))


def node_hashes(edge: np.ndarray, first: np.ndarray, last: np.ndarray, span: int = SPAN, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the nodes that edges go from and to, out of the edges' polynomials and their first and last characters."""
    up, down = _power(base, span)
    start = edge - _mixed_codes(last.astype(np.uint64), base) * up[span - 1]
    end = (edge - _mixed_codes(first.astype(np.uint64), base)) * down[1]
    return _mix(start), _mix(end)


def _sliding(x: np.ndarray, w: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over every window of w values, in time that doesn't depend on w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, fill, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return f(back[:m], ahead[w - 1 : w - 1 + m])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def fingerprints(codes: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the sampled grams: those that are the least of some stretch of ``span`` characters."""
    w = span - gram + 1
    pos, val = [], []
    for at in range(0, max(len(codes) - span + 1, 0), CHUNK):
        h = rolling(codes[at : at + CHUNK + span - 1], gram, BASES[0])
        least = _sliding(h, w, np.minimum, 2**64 - 1)
        edge = np.zeros(w - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum, 0) == h)
        pos.append(chosen + at)
        val.append(h[chosen])
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, first = np.unique(np.concatenate(pos), return_index=True)
    return p, np.concatenate(val)[first]


def edges_near(codes: np.ndarray, marks: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, polynomials and second hashes of all windows of ``span`` characters that hold a gram at one of ``marks``."""
    n = len(codes) - span + 1
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.maximum(marks - (span - gram), 0), 1)
    np.add.at(cover, np.minimum(marks, n - 1) + 1, -1)
    starts = np.flatnonzero(np.cumsum(cover[:n]) > 0)
    out = []
    for base, of in zip(BASES, (polynomials, rolling), strict=True):
        h = np.empty(n, np.uint64)
        for at in range(0, n, CHUNK):
            h[at : at + CHUNK] = of(codes[at : at + CHUNK + span - 1], span, base)
        out.append(h[starts])
    return starts, out[0], out[1]


def _fingerprint_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        docs, pos, val = [], [], []
        for d, t in zip(pdf["doc"], pdf["text"], strict=True):
            p, v = fingerprints(_codes(t))
            docs.append(np.full(len(p), d, np.int64))
            pos.append(p)
            val.append(v)
        if docs:
            yield pd.DataFrame({"fp": np.concatenate(val).view(np.int64), "doc": np.concatenate(docs), "pos": np.concatenate(pos).astype(np.int32)})


def _edge_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for d, t, marks in zip(pdf["doc"], pdf["text"], pdf["marks"], strict=True):
            codes = _codes(t)
            starts, a, b = edges_near(codes, np.asarray(marks, np.int64))
            c0, c1 = codes[starts].astype(np.int32), codes[starts + SPAN - 1].astype(np.int32)
            order = np.lexsort((starts, b, a))
            new = np.ones(len(order), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            first = np.zeros(len(order), bool)
            first[order] = new
            for i in range(0, len(starts), 100_000):
                s = slice(i, i + 100_000)
                yield pd.DataFrame({"k1": a[s].view(np.int64), "k2": b[s].view(np.int64), "doc": np.int64(d), "pos": starts[s].astype(np.int32), "first": first[s], "c0": c0[s], "c1": c1[s]})


def _node_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        start, end = node_hashes(pdf["k1"].to_numpy().view(np.uint64), pdf["c0"].to_numpy(), pdf["c1"].to_numpy())
        yield pdf.drop(columns=["c0", "c1"]).assign(start=start.view(np.int64), end=end.view(np.int64))


class SharedSpans:
    """The shared spans of at least 160 characters (code points, compared exactly) of a table of texts.

    Null, empty and shorter texts share nothing. Copies of a text share all of it if it is long enough. Other columns
    are ignored. Every stage is partitioned by fingerprint, edge or record; the only group gathered in one row is the
    list of a single record's own positions.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text"):
        d = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where((F.length("text") >= SPAN) & F.col("doc").isNotNull())
        keyed = materialise(d.select("doc", F.sha2("text", 256).alias("h"), F.length("text").cast("bigint").alias("n_chars")))
        cls = keyed.groupBy("h").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n"))
        self.copies = materialise(keyed.join(cls.where("n > 1"), "h").select("doc", "rep", "n", "n_chars"))
        self.docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
        self.texts = d.join(maybe_broadcast(self.copies.where("doc != rep").select("doc")), "doc", "left_anti")
        marks = written(self.texts.mapInPandas(_fingerprint_batches, "fp bigint, doc bigint, pos int"))
        repeated = marks.groupBy("fp").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("fp")
        near = written(marks.join(repeated, "fp", "left_semi").groupBy("doc").agg(F.collect_list("pos").alias("marks")))
        # Most texts hold no repeated fingerprint; they stay out of the shuffles.
        self.texts = maybe_in(self.texts, "doc", near.select("doc"))
        self.edges = written(self.texts.join(near, "doc").mapInPandas(_edge_batches, "k1 bigint, k2 bigint, doc bigint, pos int, first boolean, c0 int, c1 int"))
        repeated = (
            self.edges.groupBy("k1", "k2")
            .agg(F.sum(F.col("first").cast("int")).alias("n"), F.expr("bit_xor(if(first, xxhash64(doc), 0L))").alias("colour"), F.min(F.struct("doc", "pos")).alias("src"), F.first("c0").alias("c0"), F.first("c1").alias("c1"))
            .where("n > 1").select("k1", "k2", F.col("n").cast("int").alias("n"), "colour", F.col("src.doc").alias("doc"), F.col("src.pos").alias("pos"), "c0", "c1")
        )
        self.groups = written(repeated.mapInPandas(_node_batches, "k1 bigint, k2 bigint, n int, colour bigint, doc bigint, pos int, start bigint, end bigint"))

    def nodes(self) -> DataFrame:
        """``node, ins, outs`` and of the edge into it (the only one, where ins is 1) ``colour, n, doc, pos``."""
        into = self.groups.select(F.col("end").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.struct("colour", "n", "doc", "pos").alias("e"))
        out = self.groups.select(F.col("start").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast(into.schema["e"].dataType).alias("e"))
        g = into.unionByName(out).groupBy("node").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"), F.max("e").alias("e"))
        return g.select("node", "ins", "outs", *[F.col(f"e.{c}").alias(f"_{c}") for c in ("colour", "n", "doc", "pos")])

    def heads(self) -> DataFrame:
        """First edges of the compacted paths: ``k1, k2, n``. An edge goes on a path, and is left out, if the node it starts
        from doesn't branch and the edge into that node has the same colour and stands just before it in the first
        record of both; following those leads to ever smaller positions, so each path, also a circular one, has a first edge."""
        plain = self.nodes().where("ins = 1 and outs = 1").withColumnRenamed("node", "start")
        same = (F.col("_colour") == F.col("colour")) & (F.col("_n") == F.col("n")) & (F.col("_doc") == F.col("doc")) & (F.col("_pos") == F.col("pos") - 1)
        return self.groups.drop("end").join(plain, "start", "left").where(~F.coalesce(same, F.lit(False))).select("k1", "k2", "n")

    def verified(self) -> DataFrame:
        """``span, doc, n``: records by the text of a compacted path's first edge, read at its source coordinates."""
        at = self.edges.where("first").join(self.heads(), ["k1", "k2"]).select("doc", "pos", "n")
        return self.texts.join(at, "doc").select(F.expr(f"substring(text, pos + 1, {SPAN})").alias("span"), "doc", "n")

    def classes(self) -> DataFrame:
        """The links without their pairs: ``class_id, kind, doc_id, members``, a row per record and class it belongs to.
        All records of a class are linked with each other (each has members - 1 links in it). Of kind 'span' the class
        is the text of a compacted path's first edge, and its members stand for their exact copies; of kind 'copy' it is
        a text that stands in several records, and all of them are members."""
        spans = self.verified().select(F.sha2("span", 256).alias("class_id"), F.lit("span").alias("kind"), F.col("doc").alias("doc_id")).distinct()
        members = F.count(F.lit(1)).alias("members")
        spans = spans.join(spans.groupBy("class_id").agg(members).where("members > 1"), "class_id")
        copies = self.copies.select(F.sha2(F.col("rep").cast("string"), 256).alias("class_id"), F.lit("copy").alias("kind"), F.col("doc").alias("doc_id"), F.col("n").alias("members"))
        return spans.unionByName(copies)

    def pairs(self) -> DataFrame:
        """``doc_id_a, doc_id_b`` with a < b: all pairs of records that share a span, each once. Large groups are
        joined in blocks."""
        linked = _pairs_within(materialise(self.verified()), "span").distinct()
        copies = self.copies.select(F.col("rep"), F.col("doc"), "n")
        members = materialise(copies.select("rep", "doc"))
        for side in ("a", "b"):
            m = members.select(F.col("rep").alias(side), F.col("doc").alias("_d"))
            linked = linked.join(m, side, "left").withColumn(side, F.coalesce("_d", side)).drop("_d")
        both = linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(_pairs_within(copies, "rep"))
        return both.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))

    def spans(self) -> DataFrame:
        """``doc_id, span_start, span_end`` (from 0, end exclusive): the maximal stretches of each record that are
        covered by shared spans."""
        at = self.edges.join(self.groups.select("k1", "k2"), ["k1", "k2"], "left_semi").select("doc", "pos")
        w = Window.partitionBy("doc").orderBy("pos")
        new = F.coalesce(F.col("pos") > F.lag("pos").over(w) + SPAN, F.lit(True)).cast("int")
        islands = at.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w)).groupBy("doc", "_i").agg(F.min("pos").cast("bigint").alias("span_start"), (F.max("pos") + SPAN).cast("bigint").alias("span_end"))
        whole = self.copies.select(F.col("doc").alias("doc_id"), F.lit(0).cast("bigint").alias("span_start"), F.col("n_chars").alias("span_end"))
        own = islands.join(maybe_broadcast(self.copies.select("doc")), "doc", "left_anti").select(F.col("doc").alias("doc_id"), "span_start", "span_end")
        return own.unionByName(whole)

    def coverage(self) -> DataFrame:
        """``doc_id, n_chars, shared_chars, shared_part``: how much of each record stands elsewhere too; all records."""
        per = self.spans().groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
        shared = F.coalesce(F.col("shared_chars"), F.lit(0)).cast("bigint")
        return self.docs.join(per, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.coalesce(F.try_divide(shared.cast("double"), F.col("n_chars")), F.lit(0.0)).alias("shared_part"))


def _pairs_within(members: DataFrame, group: str) -> DataFrame:
    """``a < b`` for the members ``doc`` of each group. One side is dealt into blocks, the other goes to each block."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    a = members.select(group, F.col("doc").alias("a"), F.pmod(F.xxhash64("doc"), blocks).cast("int").alias("_blk"))
    b = members.select(group, F.col("doc").alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_blk"))
    return a.join(b, [group, "_blk"]).where("a < b").select("a", "b")
