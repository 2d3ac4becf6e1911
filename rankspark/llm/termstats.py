"""How often every term occurs, and in how many records.

Method: a global integer dictionary numbers the distinct terms; term counts of blocks of records are encoded with it
and accumulated into dense count arrays by identifier range, one array of occurrences and one of record presence;
the arrays are summed by range and decoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rankspark.functions.text import term_tokens
from rankspark.plans.stage import materialise, numbered

RANGE = 4096


def latest_records(docs: DataFrame, key: str, fields: list[str], at: str | None = None) -> DataFrame:
    """One row per key: a record delivered again counts once, as it came last (ties: greatest values). Rows without
    a key are dropped."""
    vals = F.struct(*([F.col(at).alias("_at")] if at else []), *[F.col(f) for f in fields])
    return docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(vals).alias("_r")).select(key, *[F.col(f"_r.{f}").alias(f) for f in fields])


def term_counts(records: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, term, tf``. With ``records`` already partitioned by key this needs no further shuffle."""
    return records.select(F.col(key), F.explode(term_tokens(text)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def dictionary(terms: DataFrame, column: str = "term") -> DataFrame:
    """``term, term_id``: distinct terms numbered from 0 without gaps. The numbers of one partition are contiguous:
    the place in the partition plus the sizes of the partitions before it."""
    return numbered(terms.select(column).distinct(), "term_id")


def _emit(blocks: dict[int, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"rng": list(blocks), "occ": [b[0] for b in blocks.values()], "df": [b[1] for b in blocks.values()]})


def _block_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Encoded counts to dense arrays per identifier range; given out in between when many ranges are open."""
    blocks: dict[int, np.ndarray] = {}
    for pdf in batches:
        ids = pdf["term_id"].to_numpy()
        rng = ids // RANGE
        for r in np.unique(rng):
            here = rng == r
            b = blocks.setdefault(int(r), np.zeros((2, RANGE), np.int64))
            np.add.at(b[0], ids[here] % RANGE, pdf["occ"].to_numpy()[here])
            np.add.at(b[1], ids[here] % RANGE, pdf["df"].to_numpy()[here])
        if len(blocks) >= 512:
            yield _emit(blocks)
            blocks = {}
    yield _emit(blocks)


def _sum_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of the arrays of each range; the rows of a range are neighbours."""
    last, total = None, None
    for pdf in batches:
        for r, occ, df in zip(pdf["rng"], pdf["occ"], pdf["df"], strict=True):
            if r != last:
                if last is not None:
                    yield _emit({last: total})
                last, total = int(r), np.zeros((2, RANGE), np.int64)
            total[0] += occ
            total[1] += df
    if last is not None:
        yield _emit({last: total})


def term_frequencies(docs: DataFrame, key: str = "docid", fields: tuple[str, ...] = ("title", "content"), at: str | None = "loaded_at", rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """``term, term_id, occurrences, records, n_records, mark`` of every term in ``fields`` of all records.

    A record is a distinct key. mark is 'rare' in fewer than ``rare_below`` records, else 'common' in more than
    ``common_above`` of all, else null. Null fields are empty; records without terms count in n_records; an empty
    table gives no rows.
    """
    records = latest_records(docs, key, list(fields), at)
    text = F.concat_ws("\n", *[F.col(f) for f in fields])
    # A block is a group of records: a term gives one row per block, however many records of it hold the term.
    tf = term_counts(records, key, text)
    n_blocks = 64
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias("block")
    blocks = materialise(tf.groupBy(block, "term").agg(F.sum("tf").alias("occ"), F.count(F.lit(1)).alias("df")))
    words = dictionary(blocks)
    encoded = blocks.join(words, "term").select("term_id", "occ", "df")
    kind = "rng bigint, occ array<bigint>, df array<bigint>"
    arrays = encoded.mapInPandas(_block_arrays, kind)
    summed = arrays.repartition("rng").sortWithinPartitions("rng").mapInPandas(_sum_arrays, kind)
    counts = summed.select("rng", F.posexplode(F.arrays_zip("occ", "df")).alias("i", "c")).select(
        (F.col("rng") * RANGE + F.col("i")).alias("term_id"), F.col("c.occ").alias("occurrences"), F.col("c.df").alias("records")
    )
    total = docs.where(F.col(key).isNotNull()).agg(F.countDistinct(key)).first()[0]
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above * total), "common")
    return counts.where("records > 0").join(words, "term_id").select("term", "term_id", "occurrences", "records", F.lit(total).alias("n_records"), mark.alias("mark"))
