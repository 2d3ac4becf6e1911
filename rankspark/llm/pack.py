"""Filling containers of fixed capacity with texts.

Method: bound-certified repacking. Items are packed best-fit decreasing within partitions of bounded size. For each
partition, dual feasible functions give a lower bound on the number of containers; a partition that meets its bound is
certified and left alone. The containers with room of the other partitions are opened, and with them as many full ones;
their items are exchanged between partitions and packed again, best-fit decreasing and, where that meets no bound, one
container after the other with the subset of a bounded choice of items that fills it best.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rankspark.plans.stage import materialise

CAPACITY = 2048
PART_ITEMS = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # must be at this place (or the parameter's) on every executor
# Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(tokens=[len(enc.encode_ordinary(t)) for t in pdf["text"]])

    return run


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, *keep, tokens bigint`` of whole texts under a byte-level vocabulary. Null texts have 0 tokens."""
    d = docs.select(key, *keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name != "text")
    return d.mapInPandas(_count_tokens(tokenizer), f"{schema}, tokens bigint")


def lower_bound(n: np.ndarray, capacity: int) -> int:
    """Least number of containers for ``n[s]`` items of each size s, by the dual feasible functions that round items above
    ``capacity - e`` up to a whole container and drop those below ``e``, for all e, and the plain sum of sizes."""
    v = np.arange(capacity + 1)
    number, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * v)])
    e = np.arange(capacity // 2 + 1)
    big = number[capacity + 1] - number[capacity - e + 1]
    middle = total[capacity - e + 1] - total[e]
    return int(np.max(big + -(-middle // capacity)))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; ``sizes`` are descending. A container is taken from those with the least room
    that suffices, the last opened of them first."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a container with room r is open
    out = np.empty(len(sizes), np.int64)
    used = 0
    for i, s in enumerate(sizes.tolist()):
        above = mask >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, used
            used += 1
        out[i] = b
        if r > s:
            room[r - s].append(b)
            mask |= 1 << (r - s)
    return out


def best_subsets(sizes: np.ndarray, capacity: int, choice: int = 192) -> np.ndarray:
    """Container number of each item; ``sizes`` are descending. A container takes the largest item left and, of
    ``choice`` items spread over the others, those that fill it best (sums reached are the bits of one number)."""
    left, size, out, k = list(range(len(sizes))), sizes.tolist(), np.empty(len(sizes), np.int64), 0
    while left:
        first = left.pop(0)
        out[first], room = k, capacity - size[first]
        step = max(1.0, len(left) / choice)
        offered = sorted({int(i * step) for i in range(min(choice, len(left)))})
        reached, within, before = 1, (1 << (room + 1)) - 1, []
        for i in offered:
            before.append(reached)
            reached |= (reached << size[left[i]]) & within
            if reached >> room:
                break
        best, used = reached.bit_length() - 1, []
        for i, mask in zip(reversed(offered[: len(before)]), reversed(before), strict=True):
            if not mask >> best & 1:
                used.append(i)
                best -= size[left[i]]
        for i in used:  # from the last place to the first
            out[left.pop(i)] = k
        k += 1
    return out


def _pack_part(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece", "id"], ascending=[False, True, True, True], kind="stable")
        sizes = pdf["size"].to_numpy()
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        bins = best_fit_decreasing(sizes, capacity)
        if len(pdf) and pdf["round"].iloc[0] > 1 and bins.max() + 1 > bound:
            other = best_subsets(sizes, capacity)
            bins = other if other.max() < bins.max() else bins
        load = np.bincount(bins, weights=sizes).astype(np.int64)
        gap = len(load) - bound
        # With a gap the containers with room are opened, and as many full ones.
        opened = load < capacity
        opened[np.flatnonzero(~opened)[: int(opened.sum())]] = True
        return pdf.assign(bin=bins, load=load[bins], gap=np.int64(gap), opened=opened[bins] & (gap > 0))

    return run


_STATE = "id bigint, doc_id bigint, piece int, n_pieces int, size bigint, round int, part bigint"


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", rounds: int = 4, part_items: int = PART_ITEMS, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, piece, n_pieces, tokens, round, part, bin, load``: where each piece of each text lies.

    (round, part, bin) name a container, ``load`` the tokens in it. A text is divided only if it exceeds the capacity
    by itself: into whole containers and a remainder. Texts without tokens (null, empty) take no room and have no row.
    Identical rows are packed as often as they stand; ties in size are ordered by doc_id and piece. Rounds go on until
    every partition meets its bound, at most ``rounds``; the last is kept as it is, and container_report() compares.
    """
    sizes = token_counts(docs, key, text, tokenizer=tokenizer).where("tokens > 0")
    n_pieces = F.ceil(F.col("tokens") / capacity).cast("int")
    pieces = sizes.select(F.col(key).cast("bigint").alias("doc_id"), n_pieces.alias("n_pieces"), "tokens", F.explode(F.sequence(F.lit(1), n_pieces)).alias("piece"))
    pieces = materialise(pieces.select("doc_id", "piece", "n_pieces", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - (F.col("piece") - 1) * F.lit(capacity)).alias("size")))
    pieces = pieces.withColumn("id", F.monotonically_increasing_id())  # of written rows, so it stays
    whole = pieces.where(F.col("size") == capacity).select("doc_id", "piece", "n_pieces", "size", F.lit(0).alias("round"), F.lit(0).cast("bigint").alias("part"), F.col("id").alias("bin"), F.lit(capacity).cast("bigint").alias("load"))
    rest = pieces.where(F.col("size") < capacity).select("id", "doc_id", "piece", "n_pieces", "size")
    n = rest.count()
    done = [whole]
    for k in range(1, rounds + 1):
        if not n:
            break
        parts = max(1, -(-n // part_items))
        spread = F.pmod(F.xxhash64("id", F.lit(k)), F.lit(parts)).alias("part")
        packed = materialise(rest.select("id", "doc_id", "piece", "n_pieces", "size", F.lit(k).alias("round"), spread).groupBy("part").applyInPandas(_pack_part(capacity), f"{_STATE}, bin bigint, load bigint, gap bigint, opened boolean"))
        if k == rounds:
            done.append(packed)
            break
        done.append(packed.where("not opened"))
        rest = packed.where("opened").select("id", "doc_id", "piece", "n_pieces", "size")
        n = rest.count()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d.select(*out.columns))
    return out.select("doc_id", "piece", "n_pieces", F.col("size").alias("tokens"), "round", "part", "bin", "load")


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, the fill and the containers that no packing could do without."""
    per = packed.groupBy("round", "part", "bin").agg(F.sum("tokens").alias("load"), F.count(F.lit(1)).alias("items"))
    t = per.agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("load").alias("tokens"), F.max("load").alias("fullest"))
    hist = packed.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per possible size
    n = np.zeros(capacity + 1, np.int64)
    for r in hist:
        n[r.tokens] += r.n
    return t.withColumn("lower_bound", F.lit(lower_bound(n, capacity))).withColumn("fill", F.try_divide(F.col("tokens"), F.col("containers") * capacity))
