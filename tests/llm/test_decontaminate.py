import hashlib
import random
import re

import numpy as np
import pytest

from effectgrid.llm.decontaminate import contamination, decontaminated, matches, suffix_array
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, n_hit string, item_id long"
ITEMS = "item_id long, text string, doc_id long"


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        windows += [(i, w[k : k + 13]) for k in range(len(w) - 12)] if len(w) >= 13 else ([(i, w)] if w else [])
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, v in windows:
            for k in range(len(w) - len(v) + 1):
                if w[k : k + len(v)] == v:
                    hit |= set(range(k, k + len(v)))
                    found.add(str(i))
        names = ",".join(sorted(found))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def sample():
    rng = random.Random(8)
    vocab = [f"W{i}" for i in range(30)] + ["é", "ÀB"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30, 60])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "?!"), (103, items[6][1]), (104, "same " * 20)]
    docs = []
    for d in range(150):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 80)))]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, len(w) + 1)
            parts += [("-" if d % 2 else " \n").join(w[a : a + rng.randrange(5, 70)]), " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30)))]
        docs.append((d, " ".join(parts)))
    docs += [(900, None), (901, ""), (902, " ... "), (903, "same " * 50), (904, " ".join(f"u{i}" for i in range(40_000)) + " " + items[7][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 22, 300, 9])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr("effectgrid.llm.decontaminate.SHARD_BYTES", 4000)
    docs, items = sample()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    b = spark.createDataFrame([(i, t, 5) for i, t in items], ITEMS)
    got = contamination(d, b, block_bytes=block_bytes).collect()
    expected = brute(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == expected
    kept = decontaminated(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in expected.items() if not x[4]}


def test_longest_matches_and_places(spark):
    item = " ".join(f"i{k}" for k in range(40))
    text = "a b c " + " ".join(f"i{k}" for k in range(5, 33)) + " z " + " ".join(f"i{k}" for k in range(20, 34))
    d = spark.createDataFrame([(1, text)], "id long, text string")
    b = spark.createDataFrame([(7, item)], "id long, text string")
    row = matches(d, b).select(F.explode("longest").alias("m")).select("m.*").collect()
    assert (7, 5, 3, 28) in [tuple(r) for r in row]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "", 2)], SCHEMA)
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    assert contamination(none, items).collect() == []
    assert [tuple(r)[:4] for r in contamination(docs, items).collect()] == [(1, 2, 0, 0)]
    assert decontaminated(docs, items).count() == 1


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        t = rng.integers(0, 4, n).astype(np.uint64)
        order = suffix_array(t, 16)
        listed = [t[i : i + 16].tolist() for i in order]
        assert listed == sorted(listed) and sorted(order.tolist()) == list(range(n))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20}, {"block_bytes": 20, "pass_blocks": 2}])
def test_rows_with_repeated_or_null_ids_and_items_without_one(spark, options):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item), (1, "clean words only"), (None, item + " x"), (None, "y z")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "q r"), (None, item), (8, "some other words"), (9, item), (None, "more and more")], "item_id long, text string")
    got = contamination(docs, items, **options).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == [
        ("1", 3, 0, 0, False), ("1", 20, 20, 2, True), ("None", 2, 0, 0, False), ("None", 21, 20, 2, True),
    ]
    assert len({r.items_sha256 for r in got if r.n_items}) == 1
