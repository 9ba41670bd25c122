"""Cuts taken over the scores of all labelled rows, from counts of value buckets.

A model is fitted on a bounded sample whose classes are capped one by one, so
shares in it are not those of the table. Cuts are therefore found on every
labelled row: rows are counted in buckets of the range of their scores, and only
the counts, at most BUCKETS of them, come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.llm.tables import stored

BUCKETS = 1 << 16


def labelled_scores(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(logit, label), written once, of all rows (id, label) that have a score; of repeated ids the smallest score."""
    return stored(scored.groupBy("id").agg(F.min("logit").alias("logit")).join(labels, "id").select("logit", "label"))


def bucket_counts(rows: DataFrame, low: float, high: float) -> tuple[np.ndarray, ...]:
    """Least and largest score, rows, and rows of label 1 of the buckets between low and high, in order."""
    bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("logit") - low) / (high - low) * BUCKETS)) if high > low else F.lit(0)
    found = rows.where(F.col("logit").between(low, high)).groupBy(bucket.alias("bucket"))
    found = found.agg(F.min("logit"), F.max("logit"), F.count(F.lit(1)), F.sum(F.col("label").cast("long"))).collect()
    table = np.array(sorted(tuple(r)[1:] for r in found), float).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64)


def whole_range(rows: DataFrame) -> tuple[float, float]:
    r = rows.agg(F.min("logit").alias("low"), F.max("logit").alias("high")).first()
    return r["low"], r["high"]


def lowest_share_cut(rows: DataFrame) -> float:
    """The quantile at the share of rows of label 0: as many rows lie below it, but for ties."""
    low, high = whole_range(rows)
    k = rows.where("label = 0").count()
    while True:
        least, most, n, _ = bucket_counts(rows, low, high)
        upto = np.cumsum(n)
        at = int(np.searchsorted(upto, k))
        if upto[at] == k and at + 1 < len(n):
            return float((most[at] + least[at + 1]) / 2)
        if least[at] == most[at] or upto[at] == k:
            return float(most[at])
        low, high, k = float(least[at]), float(most[at]), int(k - upto[at] + n[at])


def best_f1_cut(rows: DataFrame) -> float:
    """The cut between two buckets where the F1 of label 1 is largest."""
    least, most, n, hits = (x[::-1] for x in bucket_counts(rows, *whole_range(rows)))
    hit = np.cumsum(hits)
    k = int(np.argmax(2 * hit / (np.cumsum(n) + hit[-1])))
    return float((least[k] + (most[k + 1] if k + 1 < len(n) else least[k] - 1)) / 2)
