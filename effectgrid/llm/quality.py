"""Quality classifier by Bradley-Terry pairwise ranking.

A document beats another with the chance sigmoid(w . (features - features')).
The weights minimise the logistic loss over preference pairs, each of a
document labelled good and one labelled bad, drawn from a bounded sample of the
labelled rows. A document's worth is w . features; the threshold is the quantile
of the worths of all labelled documents outside the fold at their share of bad
ones, and the score puts that quantile at 0.3.

Features are shares and rates over the whole text. They are standardised by the
sample's mean and spread.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.llm.cuts import labelled_scores, lowest_share_cut
from effectgrid.llm.tables import stored
from effectgrid.llm.toxicity import allowed_labels, sigmoid, training_rows
from effectgrid.llm.words import SPACE_CUT, Words, pieces

#: Labelled rows used at most: good, and bad.
SAMPLE = (6000, 6000)
#: Preference pairs for each sampled document of the smaller class.
PAIRS = 8
CUT = 0.3
LIKELY = float(np.log(CUT / (1 - CUT)))

FEATURES = [
    "upper", "digits", "marks", "symbols", "bars", "other", "breaks", "word_length", "long_words", "short_words",
    "marked_words", "distinct", "repeats", "runs", "top_word", "pairs", "size", "empty",
]
_MARKS, _SYMBOLS = [ord(c) for c in "!?"], [ord(c) for c in "#$%&*+=@^_~<>\\/"]


def _kind(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_KINDS = {
    "upper": _kind(range(65, 91)),
    "digits": _kind(range(48, 58)),
    "marks": _kind(_MARKS),
    "symbols": _kind(_SYMBOLS),
    "bars": _kind([124]),
    "other": _kind(c for c in range(33, 127) if not (chr(c).isalnum() or c in _MARKS + _SYMBOLS + [124] or chr(c) in ".,;:'\"()-")),
    "breaks": _kind([10]),
}


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text, in the order of FEATURES; a text without words has zeros and the last one."""
    w = Words(data, offsets, SPACE_CUT)
    per_text = lambda x, at: np.diff(np.r_[0, np.cumsum(x)][at]).astype(float)
    chars, n = np.maximum(1, np.diff(offsets)), np.diff(w.first)
    words = np.maximum(1, n)
    size = w.end - w.start
    cols = {k: per_text(kind[data], offsets) / chars for k, kind in _KINDS.items()}
    cols["word_length"] = per_text(size, w.first) / words / 10
    cols["long_words"] = per_text(size > 14, w.first) / words
    cols["short_words"] = per_text(size <= 3, w.first) / words
    odd = _KINDS["marks"] | _KINDS["symbols"] | _KINDS["bars"]
    cols["marked_words"] = per_text(odd[data[w.end - 1]], w.first) / words if len(w.end) else np.zeros(len(n))
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((w.hash, doc))
    d, h = doc[order], w.hash[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])] if len(d) else np.zeros(0, bool)
    cols["distinct"] = np.bincount(d[new], minlength=len(n)) / words
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(d)])
    top = np.zeros(len(n))
    np.maximum.at(top, d[at], count)
    cols["top_word"] = top / words
    same = np.r_[False, (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])] if len(doc) else np.zeros(0, bool)
    cols["repeats"] = per_text(same, w.first) / words
    cols["runs"] = per_text(same & np.r_[False, same[:-1]], w.first) / words if len(doc) else np.zeros(len(n))
    two = w.hash[1:] * np.uint64(3) + w.hash[:-1] if len(doc) else np.zeros(0, np.uint64)
    inside = doc[1:] == doc[:-1]
    pair = np.stack([doc[1:][inside].astype(np.uint64), two[inside]]) if len(doc) else np.zeros((2, 0), np.uint64)
    order = np.lexsort((pair[1], pair[0]))
    pair = pair[:, order]
    fresh = np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)] if pair.shape[1] else np.zeros(0, bool)
    cols["pairs"] = np.bincount(pair[0][fresh].astype(np.int64), minlength=len(n)) / np.maximum(1, n - 1)
    cols["size"] = np.log1p(n) / 10
    cols["empty"] = (n == 0).astype(float)
    table = np.stack([cols[k] for k in FEATURES], axis=1)
    # shares that tell when they are small count by their root as well
    return np.concatenate([table, np.sqrt(np.maximum(0, table[:, :16]))], axis=1)


def all_features(texts: pa.Array) -> np.ndarray:
    parts = [features(data, offsets) for _, _, data, offsets in pieces(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES) + 16))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights, standardisation and threshold; a constant score unless both labels occur."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return {"constant": np.array([(len(good) + 1) / (len(label) + 2) if len(label) else 0.5])}
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / spread, -8, 8)
    n = pairs * max(len(good), len(bad))
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w, ridge = np.zeros(x.shape[1]), 1e-3
    for _ in range(30):  # Newton steps on the convex loss
        p = sigmoid(diff @ w)
        g = -diff.T @ (1 - p) / n + ridge * w
        h = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    worth = z @ w
    ordered = np.sort(worth)
    # the quantile at the share of bad documents: between the last of them and the first of the others
    k = len(bad)
    low, high = ordered[k - 1], ordered[min(k, len(ordered) - 1)]
    return {"w": w, "mean": mean, "spread": spread, "threshold": np.array([(low + high) / 2])}


def worths(p: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - p["mean"]) / p["spread"], -8, 8) @ p["w"]


def scores(p: dict, x: np.ndarray) -> np.ndarray:
    """Scores with the threshold of the fitted rows themselves."""
    if "constant" in p:
        return np.full(len(x), p["constant"][0])
    return sigmoid(worths(p, x) - p["threshold"][0] + LIKELY)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, xs, labels = [], [], []
    for b in batches:
        ids += b.column(b.schema.names.index("id")).to_pylist()
        labels += b.column(b.schema.names.index("label")).to_pylist()
        xs.append(all_features(b.column(b.schema.names.index("text"))))
    order = np.argsort(ids)
    x = np.concatenate(xs) if xs else np.zeros((0, len(FEATURES) + 16))
    to = io.BytesIO()
    np.savez(to, **fit(x[order], np.array(labels, np.int64)[order]))
    yield pa.RecordBatch.from_arrays([pa.array([to.getvalue()], pa.binary())], ["model"])


def _scored(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = dict(np.load(io.BytesIO(model)))
        for batch in batches:
            worth = np.zeros(len(batch)) if "constant" in p else worths(p, all_features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(worth, pa.float64())], ["id", "logit"])

    return run


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    fold: tuple[int, int] = (5, 0),
    sample: tuple[int, int] = SAMPLE,
) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Labels are learnt from at most sample[0] good and sample[1] bad rows, none
    of which has a crc32 of its id with remainder fold[1] by fold[0]; the
    threshold is taken over all such rows, at their share of bad ones. Null and
    empty texts have no words and a feature that says so; if only one label
    occurs, or none, all scores are its smoothed rate. Nothing but the text is
    an input of a score.
    """
    docs = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    labels = labels.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("int").alias("label"))
    rows = training_rows(docs, labels, fold, sample)
    trained = rows.repartition(1).mapInArrow(_trained, "model binary").first()  # bounded rows, one short job
    model = trained["model"] if trained else next(_trained(iter([]))).column(0)[0].as_py()
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.mapInArrow(lambda it, h=held: _scored(h.value)(it), "id long, logit double")
    p = np.load(io.BytesIO(model))
    if "constant" in p:
        score = F.lit(float(p["constant"][0]))
    else:
        scored = stored(scored)
        cut = lowest_share_cut(labelled_scores(scored, allowed_labels(labels, fold)))
        score = 1 / (1 + F.exp(cut - LIKELY - F.col("logit")))
    scored = scored.select("id", F.round(score, 9).alias("score"))
    return scored.select(
        F.col("id").alias(id_column),
        (F.crc32(F.col("id").cast("string")) % fold[0] == fold[1]).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )
