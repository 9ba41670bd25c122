"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word is read twice: as an embedding of its hash, and byte by byte by a
bidirectional GRU whose states are pooled by attention. Both make its input to
a second bidirectional GRU over the words, whose states in a window of words are
pooled by attention into one logit. A text is scored on all its overlapping
windows, one from each word on that has a whole window ahead; its largest window
counts, shifted so that the cut with the best F1 on all labelled documents outside
the fold is 0.7.

States are carried along the text, in stretches of STRETCH words that begin a
window of words early in either direction, so each word is read about once and a
state has at least a window of context. A window's attention-weighted mean is the
quotient of two sliding sums, of exp(attention) and of exp(attention) x output. The
network is trained in that form, on a window with AROUND words before and behind.

The network is trained in numpy, in one task, on a bounded sample of labelled
rows. Only documents are labelled, so a toxic document is trained on the window
that the current network finds most toxic, at first the one with the words
that lean most to toxic documents; others are trained on their worst window
and one at random. Scoring runs in the tasks that read the texts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.llm.cuts import best_f1_cut, labelled_scores
from effectgrid.llm.tables import stored
from effectgrid.llm.words import ALNUM_CUT, U64, Words, pieces

#: Words of a window, a power of two, and of a stretch.
WINDOW, STRETCH = 32, 256
#: Words around a window that training reads with it.
AROUND = 8
#: Bytes of one word input; longer words are several inputs.
WORD_BYTES = 16
BUCKETS = 4096
HIDDEN = 8
#: Labelled rows used at most: of label 1, and of label 0.
SAMPLE = (1500, 3000)
#: Batches of training; small samples are gone through more often.
STEPS, LEAST_EPOCHS = 480, 16
CUT = 0.7
LIKELY = float(np.log(CUT / (1 - CUT)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# ---- inputs ---------------------------------------------------------------


class Inputs:
    """The windows of some texts: distinct words, and for every window the places of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets, ALNUM_CUT)
        start, end, first = w.start, w.end, w.first
        size = end - start
        pieces_of = -(-size // WORD_BYTES)
        if (pieces_of > 1).any():  # long words become several inputs
            step = np.arange(pieces_of.sum()) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
            begin = np.repeat(start, pieces_of) + step * WORD_BYTES
            end = np.minimum(np.repeat(end, pieces_of), begin + WORD_BYTES)
            first = np.r_[0, np.cumsum(pieces_of)][first]
            with np.errstate(over="ignore"):
                name = np.repeat(w.hash, pieces_of) + step.astype(U64)
            start = begin
        else:
            name = w.hash
        self.names, at, self.word = np.unique(name, return_index=True, return_inverse=True)
        begin, length = start[at], (end - start)[at]
        grid = begin[:, None] + np.arange(WORD_BYTES)
        self.length = length
        self.bytes = np.where(np.arange(WORD_BYTES) < length[:, None], w.low[np.minimum(grid, max(0, len(w.low) - 1))] if len(w.low) else 0, 0).astype(np.uint8)
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        # windows: from every word with a whole window ahead; one of all words for a text with fewer
        count = np.diff(first)
        self.count, self.text = count, first[:-1]
        n = np.maximum(1, 1 + count - WINDOW)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.begin = np.repeat(first[:-1], n) + step
        self.size = np.minimum(WINDOW, np.repeat(count, n))
        self.first = np.r_[0, np.cumsum(n)]
        self.of = np.repeat(np.arange(len(n)), n)

    def words(self, windows: np.ndarray, around: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(time, window) word numbers, with words of the text before and after, and whether there is a word."""
        t = np.arange(-around, WINDOW + around)[:, None]
        at = self.begin[windows] + t
        text = self.of[windows]
        mask = (at >= self.text[text]) & (at < self.text[text] + self.count[text])
        if not len(self.word):
            return np.zeros(mask.shape, np.int64), mask
        return self.word[np.clip(at, 0, len(self.word) - 1)] * mask, mask


# ---- network --------------------------------------------------------------


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    new = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    p = {"byte": new(256, h), "word": new(BUCKETS, h) * 0.1}
    for level, width in (("c", h), ("w", 3 * h)):
        for way in "fb":
            p |= {f"W{level}{way}": new(width, 3 * h), f"b{level}{way}": np.zeros(3 * h, np.float32), f"U{level}{way}": new(h, 3 * h)}
        p[f"v{level}"] = new(2 * h)
    return p | {"out": new(2 * h), "bias": np.full(1, -1.0, np.float32)}


def gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, backward: bool, keep: list | None = None) -> np.ndarray:
    """States (time, row, HIDDEN) of projected inputs (time, row, 3 HIDDEN); padding keeps the state."""
    h, hid = HIDDEN, np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((*x.shape[:2], h), np.float32)
    steps = range(len(x) - 1, -1, -1) if backward else range(len(x))
    for t in steps:
        g = hid @ u
        zr = 1 / (1 + np.exp(-(x[t, :, : 2 * h] + g[:, : 2 * h])))
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(x[t, :, 2 * h :] + r * g[:, 2 * h :])
        new = n + z * (hid - n)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((t, hid, z, r, n, g[:, 2 * h :], m))
        hid = np.where(m, new, hid)
        out[t] = hid
    return out


def gru_back(d: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u, from those of the states."""
    h = HIDDEN
    dx, du = np.zeros((*d.shape[:2], 3 * h), np.float32), np.zeros_like(u)
    carry = np.zeros(d.shape[1:], np.float32)
    for t, hid, z, r, n, gn, m in reversed(kept):
        whole = carry + d[t]
        dh = whole * m
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (hid - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        dg = np.concatenate([dz, dr, dn * r], axis=1)
        du += hid.T @ dg
        carry = whole * ~m + dh * z + dg @ u.T
    return dx, du


def pool(states: np.ndarray, mask: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention-weighted mean of the states over time; zero where there is no word."""
    score = np.where(mask, states @ v, -1e9)
    a = np.exp(score - score.max(axis=0)) * mask
    a /= np.maximum(a.sum(axis=0), 1e-9)
    return np.einsum("tb,tbh->bh", a, states), a


def pool_back(d: np.ndarray, states: np.ndarray, a: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    da = np.einsum("bh,tbh->tb", d, states)
    ds = a * (da - (a * da).sum(axis=0))
    return a[:, :, None] * d + ds[:, :, None] * v, np.einsum("tb,tbh->h", ds, states)


def word_inputs(p: dict, bytes_: np.ndarray, length: np.ndarray, bucket: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Inputs of distinct words to the second network: hash embedding and pooled bytes."""
    steps = int(length.max(initial=1))
    codes = bytes_[:, :steps].T
    mask = np.arange(steps)[:, None] < length
    e = p["byte"][codes]
    ways, kept = [], {}
    for way in "fb":
        kept[way] = [] if keep is not None else None
        ways.append(gru(e @ p[f"Wc{way}"] + p[f"bc{way}"], mask, p[f"Uc{way}"], way == "b", kept[way]))
    states = np.concatenate(ways, axis=2)
    pooled, a = pool(states, mask, p["vc"])
    if keep is not None:
        keep |= {"codes": codes, "e": e, "states": states, "a": a, "kept": kept}
    return np.concatenate([p["word"][bucket], pooled], axis=1)


def projections(p: dict, inputs: Inputs, rows: np.ndarray | None = None, most: int = 16384) -> np.ndarray:
    """Distinct words as inputs of both directions, projected: (word, 6 HIDDEN). Shorter words together."""
    order = np.argsort(inputs.length, kind="stable") if rows is None else rows
    out = np.zeros((len(inputs.names), 6 * HIDDEN), np.float32)
    w, b = np.concatenate([p["Wwf"], p["Wwb"]], axis=1), np.concatenate([p["bwf"], p["bwb"]])
    bucket = (inputs.names % U64(BUCKETS)).astype(np.int64)
    for i in range(0, len(order), most):
        at = order[i : i + most]
        out[at] = word_inputs(p, inputs.bytes[at], inputs.length[at], bucket[at]) @ w + b
    return out


def word_products(p: dict, table: np.ndarray, inputs: Inputs, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the texts the products of its state with the attention and the output weights."""
    h = HIDDEN
    attention, output = np.zeros(len(inputs.word)), np.zeros(len(inputs.word))
    turned = np.repeat([-1.0, -2.0], [2 * h, h]).astype(np.float32)[:, None]  # gates from exp(-x), tanh from exp(-2x)
    # a last row for places without a word: its update gate is shut, so the state stays
    shut = np.repeat([40.0, 0.0], [h, 2 * h]).astype(np.float32)
    table = np.concatenate([table, np.tile(shut, 2)[None]]) * np.tile(turned[:, 0], 2)
    number = -(-inputs.count // STRETCH)
    text = np.repeat(np.arange(len(number)), number)
    start = inputs.text[text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number))
    low, high = inputs.text[text], (inputs.text + inputs.count)[text]
    size = np.minimum(high - start, STRETCH)
    order = np.argsort(-size, kind="stable")  # stretches of like length side by side
    for i in range(0, len(order), most):
        own = order[i : i + most]
        steps, m = int(size[own[0]]), len(own)
        for way, u in zip("fb", ("Uwf", "Uwb")):
            part = slice(0, h) if way == "f" else slice(h, 2 * h)
            columns = slice(0, 3 * h) if way == "f" else slice(3 * h, 6 * h)
            weights = np.concatenate([p[u].T * turned, p["vw"][None, part], p["out"][None, part]]).astype(np.float32)
            # forward from a window before the stretch, backward from a window behind it
            times = range(-WINDOW, steps) if way == "f" else range(steps + WINDOW - 1, -1, -1)
            hid, g = np.zeros((h, m), np.float32), np.zeros((3 * h + 2, m), np.float32)
            zr = np.empty((2 * h, m), np.float32)
            z, r, new = zr[:h], zr[h:], g[2 * h : 3 * h]
            for t in times:
                at = start[own] + t
                there = (at >= low[own]) & (at < np.minimum(start[own] + size[own], high[own])) if way == "f" else at < high[own]
                word = np.where(there, inputs.word[np.clip(at, 0, len(inputs.word) - 1)], len(table) - 1)
                x = table[word, columns].T
                with np.errstate(over="ignore"):
                    np.exp(np.add(x[: 2 * h], g[: 2 * h], out=zr), out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    new *= r
                    new += x[2 * h :]
                    np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1
                hid -= new
                hid *= z
                hid += new
                np.matmul(weights, hid, out=g)
                if 0 <= t < steps:
                    held = t < size[own]
                    attention[at[held]] += g[3 * h][held]
                    output[at[held]] += g[3 * h + 1][held]
    return attention, output


def sliding(values: np.ndarray) -> np.ndarray:
    """Sums of WINDOW values from each place on, by doubling, so nothing is subtracted."""
    step = 1
    while step < WINDOW:
        values = values + np.r_[values[step:], np.zeros(min(step, len(values)))]
        step *= 2
    return values


def window_logits(p: dict, inputs: Inputs, table: np.ndarray) -> np.ndarray:
    """The logit of every window; the bias alone for a text without words."""
    if not len(inputs.word):
        return np.full(len(inputs.begin), p["bias"][0], np.float32)
    attention, output = word_products(p, table, inputs)
    # texts one after another, a window of nothing between
    place = np.arange(len(inputs.word)) + WINDOW * inputs.doc
    weight, product = np.zeros(len(inputs.word) + WINDOW * len(inputs.count)), np.zeros(len(inputs.word) + WINDOW * len(inputs.count))
    weight[place] = np.exp(np.clip(attention, -60, 60))
    product[place] = weight[place] * output
    at = inputs.begin + WINDOW * inputs.of
    whole, summed = sliding(weight)[at], sliding(product)[at]
    return (np.where(whole > 0, summed / np.where(whole > 0, whole, 1), 0.0) + p["bias"][0]).astype(np.float32)


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by their place, n places."""
    return np.stack([np.bincount(at, column, n) for column in rows.T], axis=1).astype(rows.dtype)


def gradients(p: dict, inputs: Inputs, windows: np.ndarray, label: np.ndarray, weight: np.ndarray, rng) -> tuple[float, dict]:
    """Loss and gradients of a batch of windows. Hash embeddings are dropped at random, so bytes count too."""
    word, mask = inputs.words(windows, AROUND)
    used, word = np.unique(word, return_inverse=True)
    word = word.reshape(mask.shape)
    # forward over the words before and the window, backward over the window and the words behind
    reach = {"f": slice(0, AROUND + WINDOW), "b": slice(AROUND, WINDOW + 2 * AROUND)}
    inner = {"f": slice(AROUND, AROUND + WINDOW), "b": slice(0, WINDOW)}
    bucket = (inputs.names[used] % U64(BUCKETS)).astype(np.int64)
    keep: dict = {}
    x = word_inputs(p, inputs.bytes[used], inputs.length[used], bucket, keep)
    seen = (rng.random(len(used)) > 0.4).astype(np.float32)[:, None] / 0.6
    x[:, :HIDDEN] *= seen
    xs, ways, kept = x[word], [], {}
    for way in "fb":
        kept[way] = []
        own = reach[way]
        states = gru(xs[own] @ p[f"Ww{way}"] + p[f"bw{way}"], mask[own], p[f"Uw{way}"], way == "b", kept[way])
        ways.append(states[inner[way]])
    states = np.concatenate(ways, axis=2)
    pooled, a = pool(states, mask[AROUND : AROUND + WINDOW], p["vw"])
    prob = sigmoid(pooled @ p["out"] + p["bias"][0])
    loss = float(-(weight * np.where(label == 1, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))).sum() / weight.sum())
    d = ((prob - label) * weight / weight.sum()).astype(np.float32)
    g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    d_states, g["vw"] = pool_back(d[:, None] * p["out"], states, a, p["vw"])
    d_xs = np.zeros_like(xs)
    for k, way in enumerate("fb"):
        d = np.zeros((AROUND + WINDOW, len(windows), HIDDEN), d_states.dtype)
        d[inner[way]] = d_states[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        dx, g[f"Uw{way}"] = gru_back(d, p[f"Uw{way}"], kept[way])
        g[f"Ww{way}"] = np.einsum("tbi,tbj->ij", xs[reach[way]], dx, optimize=True)
        g[f"bw{way}"] = dx.sum(axis=(0, 1))
        d_xs[reach[way]] += dx @ p[f"Ww{way}"].T
    d_x = summed(word.ravel(), d_xs.reshape(-1, d_xs.shape[2]), len(x))
    g["word"] = summed(bucket, d_x[:, :HIDDEN] * seen, len(p["word"]))
    d_states, g["vc"] = pool_back(d_x[:, HIDDEN:], keep["states"], keep["a"], p["vc"])
    d_e = np.zeros_like(keep["e"])
    for k, way in enumerate("fb"):
        dx, g[f"Uc{way}"] = gru_back(d_states[:, :, k * HIDDEN : (k + 1) * HIDDEN], p[f"Uc{way}"], keep["kept"][way])
        g[f"Wc{way}"] = np.einsum("tbi,tbj->ij", keep["e"], dx, optimize=True)
        g[f"bc{way}"] = dx.sum(axis=(0, 1))
        d_e += dx @ p[f"Wc{way}"].T
    g["byte"] = summed(keep["codes"].ravel(), d_e.reshape(-1, d_e.shape[2]), len(p["byte"]))
    return loss, g


# ---- training -------------------------------------------------------------


def leaning_windows(inputs: Inputs, owner: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How much each window's most telling word, or begin of a word, leans to documents of label 1."""
    if not len(inputs.word):
        return np.zeros(len(owner))
    begins, begin = [], np.zeros(len(inputs.names), U64)
    for k in range(6):
        begin = begin * U64(257) + inputs.bytes[:, k].astype(U64)
        begins += [np.unique(begin, return_inverse=True)[1]] * (k >= 2)
    lean = np.zeros(len(inputs.names))
    for name in (np.arange(len(inputs.names)), *begins):
        pair = np.unique(inputs.doc * np.int64(len(inputs.names) + 1) + name[inputs.word])
        d, k = pair // (len(inputs.names) + 1), pair % (len(inputs.names) + 1)
        pos = np.bincount(k[label[d] == 1], minlength=len(inputs.names))
        neg = np.bincount(k[label[d] == 0], minlength=len(inputs.names)) * (label.sum() / max(1, (label == 0).sum()))
        lean = np.maximum(lean, ((pos - neg) / np.sqrt(pos + neg + 1))[name])
    out = np.empty(len(owner))
    for i in range(0, len(owner), 1 << 16):
        word, mask = inputs.words(np.arange(i, min(i + (1 << 16), len(owner))))
        out[i : i + (1 << 16)] = np.where(mask, lean[word], -1).max(axis=0)
    return out


def fit(texts: list[str | None], labels: list[int], steps: int = STEPS, seed: int = 1) -> dict[str, np.ndarray]:
    """The parameters; a constant score unless both labels occur."""
    label = np.array(labels, np.int64)
    p = initial(seed)
    if not len(label) or label.min() == label.max():
        base = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.5
        return p | {"constant": np.array([base])}
    rng = np.random.default_rng(seed)
    parts = list(pieces(pa.array(texts, pa.string()), 1 << 62))
    inputs = Inputs(*parts[0][2:])
    owner = np.repeat(np.arange(len(label)), np.diff(inputs.first))
    score = leaning_windows(inputs, owner, label)
    begin, n = inputs.first[:-1], np.diff(inputs.first)
    m = {k: np.zeros_like(x) for k, x in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    size, step = 256 if len(label) > 1000 else 64, 0
    epochs = max(LEAST_EPOCHS, -(-steps * size // (2 * len(label))))

    def top_of(score):  # the first of the largest windows of each document, in document order
        at = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, begin), n))
        return at[np.unique(owner[at], return_index=True)[1]]

    for epoch in range(epochs):
        if epoch and epoch % 4 == 0:
            score = window_logits(p, inputs, projections(p, inputs))
        lead = top_of(score)
        # any window of a clean document may be drawn
        chance = begin + (rng.random(len(n)) * n).astype(np.int64)
        windows = np.r_[lead, chance[label == 0]]
        y = label[owner[windows]]
        weight = np.where(y == 1, (y == 0).sum() / max(1, (y == 1).sum()) * 0.5, 1.0)
        order = rng.permutation(len(windows))
        rate = 0.012 * (0.5 if epoch > epochs * 0.6 else 1.0) * (0.4 if epoch > epochs * 0.85 else 1.0)
        for i in range(0, len(order), size):
            at = order[i : i + size]
            _, g = gradients(p, inputs, windows[at], y[at], weight[at], rng)
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 2.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                p[k] = p[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


# ---- Spark jobs -----------------------------------------------------------


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["id"], r["text"], r["label"]) for b in batches for r in b.to_pylist())
    p = fit([t for _, t, _ in rows], [y for _, _, y in rows])
    to = io.BytesIO()
    np.savez(to, **p)
    yield pa.RecordBatch.from_arrays([pa.array([to.getvalue()], pa.binary())], ["model"])


def text_logits(p: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    inputs = Inputs(data, offsets)
    score = window_logits(p, inputs, projections(p, inputs))
    return np.maximum.reduceat(score, inputs.first[:-1])


def _scored(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = dict(np.load(io.BytesIO(model)))
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1), 1 << 23):
                score = np.zeros(j - i) if "constant" in p else text_logits(p, data, offsets).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(score)], ["id", "logit"])

    return run


def allowed_labels(labels: DataFrame, fold: tuple[int, int]) -> DataFrame:
    """(id, label) of all labelled rows outside the fold; of repeated labels of an id the larger counts."""
    modulus, rest = fold
    own = labels.where(F.col("label").isin(0, 1)).where(F.crc32(F.col("id").cast("string")) % modulus != rest)
    return own.groupBy("id").agg(F.max("label").alias("label"))


def training_rows(docs: DataFrame, labels: DataFrame, fold: tuple[int, int], sample: tuple[int, int]) -> DataFrame:
    """(id, text, label) of a bounded sample of labelled rows outside the fold, by a hash of their ids.

    Of repeated labels of an id the larger counts, of repeated texts the smaller.
    """
    own = allowed_labels(labels, fold)
    order = [F.xxhash64("id"), F.col("id")]
    some = own.where("label = 1").orderBy(*order).limit(sample[0]).unionAll(own.where("label = 0").orderBy(*order).limit(sample[1]))
    found = docs.join(F.broadcast(some), "id")  # at most the sample's rows
    return found.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    fold: tuple[int, int] = (3, 1),
    sample: tuple[int, int] = SAMPLE,
) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Labels are learnt from at most sample[0] rows of label 1 and sample[1] of
    label 0, none of which has a crc32 of its id with remainder fold[1] by
    fold[0]; the cut is taken over all such rows. Null and empty texts get the score of an empty window; if only one
    label occurs, or none, all scores are its smoothed rate. Nothing but the
    text is an input of a score.
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
        cut = best_f1_cut(labelled_scores(scored, allowed_labels(labels, fold)))
        score = 1 / (1 + F.exp(cut - LIKELY - F.col("logit")))
    scored = scored.select("id", F.round(score, 9).alias("score"))
    return scored.select(
        F.col("id").alias(id_column),
        (F.crc32(F.col("id").cast("string")) % fold[0] == fold[1]).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )
