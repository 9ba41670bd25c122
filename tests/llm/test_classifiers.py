import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from effectgrid.llm import quality, toxicity
from effectgrid.llm.words import ALNUM_CUT, Words, pieces

SCHEMA = "doc_id long, text string, lang string, score string"
LABELS = "doc_id long, toxic int, quality int, text string"


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


# ---- toxicity -------------------------------------------------------------


def corpus(n, seed=1):
    """Toxic texts hold some words of a list, or words that begin like others of a list."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioustrnml") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 160))]
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            bad = rng.choice(["zork", "blag"]) if rng.random() < 0.5 else "quib" + rng.choice(vocab)
            words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_texts_are_told_apart(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "x", "s") for i, t, _ in rows] + [(5000, None, None, None), (5001, "", None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, y, 1, "t") for i, _, y in rows] + [(1, None, None, None), (77777, 1, 1, "")], LABELS)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 902
    held = [(got[i], y) for i, _, y in rows if fold(i, 3) == 1]
    assert all(r.held_out for r, _ in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    right = sum(r.predicted == y for r, y in held)
    assert right >= 0.93 * len(held)
    assert got[5000].score == got[5001].score < 0.7


def test_cut_is_best_at_the_shares_of_all_labelled_rows(spark):
    """The sample is capped by class, the cut is not."""
    rows = corpus(300)
    rows = [x for x in rows if not x[2] or x[0] % 2]
    docs = spark.createDataFrame([(i, t, "x", "s") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y, 1, "") for i, _, y in rows], LABELS)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, sample=(20, 10)).collect()}
    score, y = (np.array(x) for x in zip(*((got[i], y) for i, _, y in rows if fold(i, 3) != 1)))
    f1 = lambda cut: 2 * (y[score >= cut]).sum() / ((score >= cut).sum() + y.sum())
    assert f1(0.7) >= max(f1(c) for c in score) - 1e-12


def test_labels_of_the_fold_change_nothing(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(i, t, "x", "s") for i, t, _ in rows], SCHEMA)
    scores = []
    for flip in (0, 1):
        labels = [(i, y ^ (flip and fold(i, 3) == 1), 1, "") for i, _, y in rows]
        found = toxicity.toxicity(docs, spark.createDataFrame(labels, LABELS), sample=(20, 20))
        scores.append(sorted((r.doc_id, r.score) for r in found.collect()))
    assert scores[0] == scores[1]


@pytest.mark.parametrize("module, run", [(toxicity, toxicity.toxicity), (quality, quality.quality)])
def test_one_label_or_none(spark, module, run):
    docs = spark.createDataFrame([(i, "some text here", "en", None) for i in range(9)], SCHEMA)
    none = run(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5}
    ones = run(docs, spark.createDataFrame([(i, 1, 1, "") for i in range(9)], LABELS)).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.7
    assert run(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).collect() == []


def test_windows_cover_every_word():
    texts = ["", "a b", "w " * 31, "w " * 32, "w " * 33, "w " * 1000, "x" * 100, "é" * 40 + " b", None]
    (_, _, data, offsets), = pieces(pa.array(texts))
    inputs = toxicity.Inputs(data, offsets)
    words = np.diff(Words(data, offsets, ALNUM_CUT).first)
    assert len(inputs.first) == len(texts) + 1
    for k in range(len(texts)):
        at = range(inputs.first[k], inputs.first[k + 1])
        covered = {int(inputs.begin[w]) + t for w in at for t in range(int(inputs.size[w]))}
        first = int(np.searchsorted(inputs.doc, k))
        n = int((inputs.doc == k).sum())
        assert covered == set(range(first, first + n)) and n >= words[k]
        begins = [int(inputs.begin[w]) for w in at]
        assert begins == list(range(first, first + len(begins))) and len(begins) == max(1, n - toxicity.WINDOW + 1)


def plain_window_logits(p, inputs, text):
    """Stretch by stretch and window by window, one word at a time."""
    h, w = toxicity.HIDDEN, toxicity.WINDOW
    table = toxicity.projections(p, inputs)
    word = inputs.word[inputs.doc == text]
    n = len(word)
    if not n:
        return [p["bias"][0]]
    states = np.zeros((n, 2 * h), np.float32)
    for start in range(0, n, toxicity.STRETCH):
        end = min(n, start + toxicity.STRETCH)
        for way, low, high, columns in (("f", max(0, start - w), end, slice(0, 3 * h)), ("b", start, min(n, end + w), slice(3 * h, 6 * h))):
            x = table[word[low:high], columns][:, None]
            found = toxicity.gru(x, np.ones((high - low, 1), bool), p[f"Uw{way}"], way == "b")[:, 0]
            states[start:end, (way == "b") * h : (way == "b") * h + h] = found[start - low : end - low]
    out = []
    for begin in range(max(1, n - w + 1)):
        own = states[begin : begin + w][:, None]
        out.append(toxicity.pool(own, np.ones(own.shape[:2], bool), p["vw"])[0][0] @ p["out"] + p["bias"][0])
    return out


@pytest.mark.parametrize("stretch", [256, 40])
def test_every_window_is_scored(monkeypatch, stretch):
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, n)) for n in (0, 1, 31, 32, 33, 150, 256, 257, 700)]
    (_, _, data, offsets), = pieces(pa.array(texts))
    p = {k: v * 3 for k, v in toxicity.initial(4).items()}
    inputs = toxicity.Inputs(data, offsets)
    each = toxicity.window_logits(p, inputs, toxicity.projections(p, inputs))
    plain = [plain_window_logits(p, inputs, k) for k in range(len(texts))]
    assert np.diff(inputs.first).tolist() == [len(x) for x in plain]
    np.testing.assert_allclose(each, np.concatenate(plain), atol=2e-4)
    assert np.ptp(each) > 0.1
    np.testing.assert_allclose(toxicity.text_logits(p, data, offsets), [max(x) for x in plain], atol=2e-4)


def test_sliding_sums_keep_small_values_beside_large_ones():
    values = np.r_[np.full(40, 1e-20), 1e20, np.full(80, 1e-20)]
    plain = [values[i : i + toxicity.WINDOW].sum() for i in range(len(values))]
    np.testing.assert_allclose(toxicity.sliding(values), plain, rtol=1e-12)


def test_training_looks_at_every_window():
    """The one toxic passage of a long text is what training sees first, wherever it lies."""
    clean = [" ".join(f"w{(7 * i + k) % 90}" for k in range(3000)) for i in range(6)]
    for at in (5, 777, 1600, 2990):
        words = clean[0].split()
        words[at] = "zork"
        (_, _, data, offsets), = pieces(pa.array([" ".join(words), *clean[1:]]))
        inputs = toxicity.Inputs(data, offsets)
        owner = np.repeat(np.arange(6), np.diff(inputs.first))
        lean = toxicity.leaning_windows(inputs, owner, np.array([1, 0, 0, 0, 0, 0]))
        best = inputs.begin[np.flatnonzero((owner == 0) & (lean == lean.max()))]
        assert len(best) == min(at, 3000 - toxicity.WINDOW) - max(0, at - toxicity.WINDOW + 1) + 1
        assert ((best <= at) & (at < best + toxicity.WINDOW)).all()


def test_gradients_against_differences():
    texts = ["one two three four five", "six one", "seven longerwordthanonepiece eight nine", ""]
    (_, _, data, offsets), = pieces(pa.array(texts))
    inputs = toxicity.Inputs(data, offsets)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(3).items()}
    windows, label, weight = np.arange(4), np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 1.0, 0.5])

    class Every:  # no dropout

        def random(self, n):
            return np.ones(n)

    _, g = toxicity.gradients(p, inputs, windows, label, weight, Every())
    rng = np.random.default_rng(1)
    for name in p:
        flat = np.flatnonzero(np.abs(g[name]).ravel() > 1e-5)
        for at in rng.choice(flat, min(3, len(flat)), replace=False):
            losses = []
            for step in (1e-3, -1e-3):
                q = {k: v.copy() for k, v in p.items()}
                q[name].ravel()[at] += step
                losses.append(toxicity.gradients(q, inputs, windows, label, weight, Every())[0])
            assert abs((losses[0] - losses[1]) / 2e-3 - g[name].ravel()[at]) < 2e-3 + 0.03 * abs(g[name].ravel()[at]), name


def test_batches_of_texts_do_not_change_scores():
    texts = [t for _, t, _ in corpus(30)]
    p = toxicity.initial()
    (_, _, data, offsets), = pieces(pa.array(texts))
    whole = toxicity.text_logits(p, data, offsets)
    single = [toxicity.text_logits(p, *next(pieces(pa.array([t])))[2:])[0] for t in texts]
    assert np.allclose(whole, single, atol=1e-4)


# ---- quality --------------------------------------------------------------


def plain_features(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    n = max(1, len(w))
    size = max(1, len(text.encode()))
    pairs = {(a, b) for a, b in zip(w, w[1:])}
    return {
        "upper": sum("A" <= c <= "Z" for c in text) / size,
        "bars": text.count("|") / size,
        "breaks": text.count("\n") / size,
        "distinct": len(set(w)) / n,
        "repeats": sum(a == b for a, b in zip(w, w[1:])) / n,
        "runs": sum(a == b == c for a, b, c in zip(w, w[1:], w[2:])) / n,
        "top_word": max((w.count(x) for x in set(w)), default=0) / n,
        "pairs": len(pairs) / max(1, len(w) - 1),
        "marked_words": sum(x[-1] in "!?#$%&*+=@^_~<>\\/|" for x in w) / n,
        "empty": float(not w),
    }


def test_features_against_plain_ones():
    texts = ["A b! b | c", "", " \n", "x x x x", "é É ß?", "one\ntwo one\ntwo one", "Z" * 50, "a " * 3000]
    got = quality.all_features(pa.array(texts))
    for row, text in zip(got, texts):
        for name, value in plain_features(text).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value), (name, text)
    assert quality.all_features(pa.array([], pa.string())).shape[0] == 0


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(
        spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == 1002
    held = [(r, truth[i]) for i, r in got.items() if r.held_out and i in truth]
    assert all(r.held_out == (fold(i, 5) == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held) and len(held) > 50


@pytest.mark.parametrize("sample", [(60, 60), (20, 60), (6000, 6000)])
def test_quality_cut_is_the_quantile_of_all_labelled_rows(spark, sample):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.quality(docs, labels, sample=sample).collect() if not r.held_out and truth.get(r.doc_id) in (0, 1)]
    bad = sum(truth[r.doc_id] == 0 for r in got)
    assert len(got) > 300 and 0 < bad < len(got) / 3
    assert abs(sum(r.predicted == 0 for r in got) - bad) <= 1


def test_quantile_in_buckets(spark):
    """Against sorting, with ties and far values that leave most rows in one bucket."""
    from effectgrid.llm import cuts

    rng = np.random.default_rng(2)
    for x in (rng.normal(size=300), np.r_[rng.normal(size=300) * 1e-7, 1e6, -1e6], np.repeat([1.0, 2.0], 50), np.full(9, 3.0)):
        label = (rng.random(len(x)) < 0.8).astype(int)
        rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, label)], "logit double, label int")
        ordered, k = np.sort(x), int((label == 0).sum())
        assert ordered[k - 1] <= cuts.lowest_share_cut(rows) <= ordered[min(k, len(x) - 1)]


def test_ranking_prefers_good_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    worth = x @ [2.0, -1.0, 0.0, 0.5]
    label = (worth + rng.normal(size=400) * 0.3 > -1).astype(int)
    p = quality.fit(x, label)
    s = quality.scores(p, x)
    good, bad = s[label == 1], s[label == 0]
    assert (good[:, None] > bad).mean() > 0.97
    assert abs((s < 0.3).sum() - (label == 0).sum()) <= 1  # the quantile is the cut
    to = io.BytesIO()
    np.savez(to, **p)
