import random
import re

import numpy as np
import pytest

from effectgrid.llm.components import components
from effectgrid.llm.ngram_join import block_keys, dense_sketch, ngram_classes, one_of_each, scheme_of
from effectgrid.llm.ngram_links import ngram_joined, ngram_pairs, shared_members

SCHEMA = "doc_id long, text string, lang string, n_shingles string"


def brute(docs, links=None):
    sets, parent = {}, {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                if links is not None:
                    links.append((a, b))
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.random()}"
    return out


def test_against_all_pairs(spark, monkeypatch):
    """Classes and all links: chains at the threshold, a shared passage, hot groups, every size band."""
    monkeypatch.setattr("effectgrid.llm.ngram_links.CHUNK_SETS", 5)
    monkeypatch.setattr("effectgrid.llm.ngram_links.COLUMNS", 64)
    monkeypatch.setattr("effectgrid.llm.ngram_join.CHUNK", 8)
    rng, docs = random.Random(5), []
    passage = [f"p{i}" for i in range(40)]
    for size in (3, 4, 5, 6, 9, 20, 63, 68, 100, 131, 250, 600):
        base = [f"b{size}_{i}" for i in range(size)]
        for n in (0, 0, 1, 1, 2, size // 40, size // 25, size // 18, size // 15, size // 12):
            docs.append(edited(rng, base, n))
        walk = base
        for _ in range(6):  # each is near the one before, not near the first
            walk = edited(rng, walk, max(1, size // 30))
            docs.append(walk)
    docs += [passage + [f"x{k}_{i}" for i in range(rng.randrange(0, 60))] for k in range(60)]
    docs = [" ".join(d) for d in docs] + [None, "", " \t\n", "One two", "one TWO", "two one", "one\ntwo"]
    rows = [(i * 3, t, None, "x") for i, t in enumerate(docs)]
    rng.shuffle(rows)
    df, links = spark.createDataFrame(rows, SCHEMA), []
    joined = {r.doc_id: r for r in ngram_joined(df).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in joined.items()} == brute([r[:2] for r in rows], links)
    assert {i: r.n_links for i, r in joined.items()} == {i: sum(i in x for x in links) for i in joined}
    between = {(min(x), max(x)) for a, b in links if len(x := {joined[a].class_id, joined[b].class_id}) == 2}
    pairs = [tuple(r) for r in ngram_pairs(df).collect()]
    assert set(pairs) == between and len(pairs) == len(between) > 50


def test_edges(spark, near_texts):
    assert ngram_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    none = ngram_classes(spark.createDataFrame([(1, None, None, None), (2, "", None, None)], SCHEMA)).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 1), (2, 0, 2)]
    long = near_texts(range(30_000))
    rows = [(9, long, "en", "a"), (4, long.upper(), "en", "a"), (7, long + " z", "en", "a"), (5, "other words here", "en", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.component_id for r in ngram_classes(df).collect()} == {9: 4, 4: 4, 7: 4, 5: 5}
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_joined(df).collect()} == {9: (4, 2), 4: (4, 2), 7: (7, 2), 5: (5, 0)}
    assert ngram_joined(df.limit(0)).collect() == [] == ngram_pairs(df.limit(0)).collect()
    odd = spark.createDataFrame([(None, "a b", None, None), (3, "A B", None, None), (4, None, None, None), (None, None, None, None)], SCHEMA)
    got = sorted((tuple(r) for r in ngram_joined(odd).collect()), key=str)
    assert got == sorted([(None, 1, 3, 3, 1), (3, 1, 3, 3, 1), (4, 0, 4, 4, 0), (None, 0, None, None, 0)], key=str)
    kept = one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5]


@pytest.mark.parametrize("size", [1, 2, 5, 30, 63, 64, 90, 127, 128, 500, 3000])
def test_pairs_at_the_threshold_share_blocks(size):
    rng = np.random.default_rng(size)
    for _ in range(40):
        common = rng.integers(0, 2**64 - 1, size, dtype=np.uint64)
        extra = rng.integers(0, 2**64 - 1, size // 3, dtype=np.uint64)
        a, b = np.unique(common), np.unique(np.r_[common, extra])
        keys = []
        for s in (a, b):
            k = scheme_of(len(s))
            higher = scheme_of(int(len(s) / 0.75 + 1e-9)) > k
            keys.append({*block_keys(s, k).tolist(), *(block_keys(s, k + 1).tolist() if higher else [])})
        assert keys[0] & keys[1]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n, m in ((10, 3), (60, 60), (200, 11)):
        a = rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
        b = np.r_[a[m // 2 :], rng.integers(0, 2**64 - 1, m, dtype=np.uint64)]
        x, y = (np.frombuffer(dense_sketch(s, 2), np.uint8) for s in (a, b))
        assert np.unpackbits(x ^ y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_shared_members(monkeypatch):
    monkeypatch.setattr("effectgrid.llm.ngram_links.COLUMNS", 7)
    rng = np.random.default_rng(4)
    left, right = ([np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in sizes] for sizes in ((0, 5, 40, 9), (30, 1, 0)))
    assert shared_members(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert shared_members([], right).shape == (0, 3)


@pytest.mark.parametrize("links_in_a_task", [10**6, 7])
def test_components_of_paths_and_stars(spark, monkeypatch, links_in_a_task):
    monkeypatch.setattr("effectgrid.llm.components.TASK_LINKS", links_in_a_task)
    rng, links = random.Random(2), [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(200, 260)]}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
