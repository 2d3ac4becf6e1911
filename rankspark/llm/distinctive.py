"""How characteristic a term is of a record.

Method: the occurrence counts of a term over all records, those without it included, are taken as a mixture of two
Poisson distributions: records that are about what the term names (elite) and the others. The mixture is fitted by
expectation-maximisation on the term's frequency histogram; the score of a term in a record is the posterior
probability that the record is elite, weighted by how surprising eliteness is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rankspark.llm.termstats import latest_records, term_counts
from rankspark.plans.stage import materialise

ITERATIONS = 40
_SCHEMA = "term string, records bigint, elite double, high double, low double, best double"


def fit_two_poisson(tf: np.ndarray, n: np.ndarray, start: np.ndarray, n_records: int, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elite share and the two means of each term. ``tf``/``n`` are the histograms of all terms end to end, ``start``
    where each begins; counts of zero are implied by ``n_records``. All terms are fitted at once, each for itself."""
    tf, n = tf.astype(float), n.astype(float)
    m = len(start)
    size = np.diff(np.append(start, len(tf)))
    own = np.repeat(np.arange(m), size)
    df = np.add.reduceat(n, start)
    occ = np.add.reduceat(n * tf, start)
    zeros = np.maximum(n_records - df, 0.0)
    mean = occ / df
    high, low = np.maximum(mean, 1.0), np.maximum(occ / max(n_records, 1) * 0.5, 1e-9)
    high = np.where(high <= low, low * 1.5 + 1e-6, high)
    p = np.clip(df / max(n_records, 1) * 0.5, 1e-12, 1 - 1e-12)
    for _ in range(iterations):
        odds = np.log(p) - np.log1p(-p)
        at0 = odds - (high - low)
        post0 = 1 / (1 + np.exp(np.clip(-at0, -700, 700)))
        post = 1 / (1 + np.exp(np.clip(-(at0[own] + tf * np.log(high / low)[own]), -700, 700)))
        e = np.add.reduceat(n * post, start) + zeros * post0
        s = np.add.reduceat(n * post * tf, start)
        p = np.clip(e / max(n_records, 1), 1e-12, 1 - 1e-12)
        high = np.maximum(s / np.maximum(e, 1e-12), 1e-9)
        low = np.maximum((occ - s) / np.maximum(n_records - e, 1e-12), 1e-9)
        high = np.maximum(high, low)
    return p, high, low


def best_scores(most: np.ndarray, p: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Score of each term where it is used most: no record of the term has a higher one."""
    log_odds = np.log(p) - np.log1p(-p) - (high - low) + most * np.log(high / low)
    return -np.log2(p) / (1 + np.exp(np.clip(-log_odds, -700, 700)))


def least_score(n_records: int, least_tf: int, most_records: int) -> float:
    """A score that the best record of every term reaches which stands in at most ``most_records`` records and is used
    at least ``least_tf`` times in one of them.

    The mean of its counts is at least (most_records - 1 + least_tf) / most_records. Where all its records are elite,
    their mean m fulfils m / (1 - exp(-m)) = that, and the elite share is most_records / (1 - exp(-m)) of n_records: no
    fit gives a greater one. There, the posterior of the greatest count is close to 1.
    """
    mean = (most_records - 1 + least_tf) / most_records
    m = mean
    for _ in range(200):
        m = mean * -math.expm1(-m)
    return 0.99 * max(math.log2(max(n_records, 1) * -math.expm1(-m) / most_records), 0.0)


def _fit(n_records: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sizes = pdf["hist"].map(len).to_numpy()
            flat = [e for h in pdf["hist"] for e in h]
            tf, n = np.array([e["tf"] for e in flat]), np.array([e["n"] for e in flat])
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            p, high, low = fit_two_poisson(tf, n, start, n_records)
            best = best_scores(np.maximum.reduceat(tf, start), p, high, low)
            yield pd.DataFrame({"term": pdf["term"], "records": np.add.reduceat(n, start), "elite": p, "high": high, "low": low, "best": best})

    return run


def count_records(docs: DataFrame, key: str = "docid") -> int:
    return docs.where(F.col(key).isNotNull()).agg(F.countDistinct(key)).first()[0]


def distinctive_terms(docs: DataFrame, key: str = "docid", field: str = "content", at: str | None = "loaded_at", n_records: int | None = None) -> DataFrame:
    """``key, term, tf, records, posterior, score, best`` for every term of every record.

    score is posterior x -log2(elite share): near 0 for terms that are common or used as chance would have it, high
    for rare terms used often; best is the term's highest score in any record. Null and blank texts have no terms. The
    join of counts with fitted terms is on the term; its left side can be split where a term stands in very many
    records (adaptive skew join).
    """
    tf = materialise(term_counts(latest_records(docs, key, [field], at), key, F.col(field)))
    n_records = count_records(docs, key) if n_records is None else n_records
    hist = tf.groupBy("term", "tf").agg(F.count(F.lit(1)).alias("n"))
    # As long as the number of different frequencies of a term, not as its records.
    per_term = hist.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("tf", "n"))).alias("hist"))
    fitted = per_term.mapInPandas(_fit(n_records), _SCHEMA)
    log_odds = F.log("elite") - F.log1p(-F.col("elite")) - (F.col("high") - F.col("low")) + F.col("tf") * F.log(F.col("high") / F.col("low"))
    post = F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.greatest(-log_odds, F.lit(-700.0)), F.lit(700.0))))
    return tf.join(fitted, "term").withColumn("posterior", post).select(
        key, "term", "tf", "records", "posterior", (F.col("posterior") * -F.log2("elite")).alias("score"), "best"
    )


def rare_and_repeated(docs: DataFrame, least_tf: int = 4, least_records: int = 2, most_records: int = 6, key: str = "docid", field: str = "content") -> DataFrame:
    """``key, term, tf, records`` of the terms used at least ``least_tf`` times in a record and standing in
    ``least_records`` to ``most_records`` records.

    The scores find the candidates: rows whose own score, or whose term's best score, reaches least_score(); a record
    with few uses of a term that others use far more isn't elite by itself, but its term is. What is written are the
    candidates alone; their counts then confirm them exactly.
    """
    n = count_records(docs, key)
    scored = distinctive_terms(docs, key, field, n_records=n)
    least = least_score(n, least_tf, most_records)
    candidates = materialise(scored.where(F.greatest("score", "best") >= F.lit(least)).select(key, "term", "tf", "records"))
    return candidates.where((F.col("tf") >= least_tf) & F.col("records").between(least_records, most_records))
