import hashlib
import random

import numpy as np
import pytest

from effectgrid.llm.exact_dedup import LEAST, MOST, cut_points, exact_groups, without_copies

SCHEMA = "doc_id long, text string, keep_id string, lang string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    return {
        i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for i in ids
    }


def texts():
    rng = random.Random(3)
    long = " ".join(str(rng.random()) for _ in range(9000))
    base = [long, long.upper(), long + "x", "x" + long, long[:-1], "a" * 50_000, "a" * 50_001, "Ä", "ä", "ab", "AB", "", None, " ", "é" * 300]
    return base + [long] * 20 + ["ab"] * 7 + [None]


@pytest.mark.parametrize("bits", [64, 3])
def test_against_brute_force(spark, bits):
    """3 bits: nearly every digest has several contents, so numbers must tell them apart."""
    rows = [(i * 5 % 997, t, "clash", None) for i, t in enumerate(texts())]
    got = exact_groups(spark.createDataFrame(rows, SCHEMA), digest_bits=bits).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute([r[:2] for r in rows])


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_groups(empty).collect() == [] and without_copies(empty).columns == empty.columns
    df = spark.createDataFrame([(1, "A b", "k", None), (2, "a B", "l", "en"), (3, None, None, None)], SCHEMA)
    assert sorted(map(tuple, without_copies(df).collect())) == [(2, "a B", "l", "en"), (3, None, None, None)]


def test_cuts_follow_the_content():
    rng = np.random.default_rng(4)
    a = rng.integers(97, 123, 60_000).astype(np.uint8)
    b = np.r_[rng.integers(97, 123, 777).astype(np.uint8), a]
    x, y = cut_points(a), cut_points(b)
    assert x[-1] == len(a) and (np.diff(np.r_[0, x])[:-1] >= LEAST).all() and (np.diff(np.r_[0, x]) <= MOST).all()
    assert len({*x.tolist()} & {*(y - 777).tolist()}) > 0.8 * len(x)
