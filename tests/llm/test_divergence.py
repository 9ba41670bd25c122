import random
import re
from collections import Counter

import numpy as np
import pytest

from effectgrid.llm import divergence, transducer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string"


def plain(rows, least=10, top=10):
    texts = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {t[0] for t in texts}:
        mine = [t for t in texts if t[0] == lang]
        seen = Counter(w for t in mine for w in set(t[2]))
        kept = [w for w in seen if seen[w] >= least]
        counts = {s: Counter() for s in {t[1] for t in mine}}
        for _, s, words in mine:
            counts[s].update(w for w in words if seen[w] >= least)
        whole = sum(counts.values(), Counter())

        def share(c, w):
            return 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in counts.items():
            pairs = sorted(((-sum(f(share(c, w), share(o, w)) for w in kept), i.encode()) for i, o in counts.items() if i != s))
            terms = sorted((-f(share(c, w), share(whole, w)), w.encode()) for w in c if share(c, w) > share(whole, w))[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)]
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(1, t, lang, s, 0, "x") for t, lang, s in rows], SCHEMA)
    out = divergence.divergence(docs, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, out.collect()))


def some_rows(n=400, seed=1, sources=7):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdéZ" for b in "xyñ日"] + ["Ab", "aB", "a", "ab", "abc"]
    rows = []
    for _ in range(n):
        source = rng.choice([None, "", *(f"s{i}" for i in range(sources))])
        text = rng.choice([" ", ", ", "7"]).join(rng.choices(words, k=rng.randint(0, 30)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None, "x"]), source))
    return rows + [(rows[0][0], "en", "s1")] * 50


@pytest.mark.parametrize("options", [{}, {"block_bytes": 40, "model_bytes": 1500}])
def test_against_plain(spark, options, monkeypatch):
    rows = some_rows() + [("q " * 3000 + "w" * 20000, "en", "long")] * 10 + [("rare", "solo", "one")]
    if options:
        monkeypatch.setattr(divergence, "TILE_TERMS", 7)
        monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
        monkeypatch.setattr(divergence, "HELD", 5)
    assert run(spark, rows, **options) == plain(rows)


def test_no_kept_terms_and_empty(spark):
    rows = [("a b", "en", "s1"), (None, "en", "s2"), ("x", None, None)]
    assert run(spark, rows) == plain(rows) == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)]
    assert run(spark, []) == []


def test_transducer_is_minimal_and_gives_places():
    rng = random.Random(2)
    for _ in range(30):
        terms = sorted({"".join(rng.choices("abé", k=rng.randint(1, 6))).encode() for _ in range(rng.randint(0, 60))})
        model = transducer.Transducer.unpacked(transducer.build(terms).packed())
        asked = terms + [b"zz", b"a" * 9, "é".encode()[:1]] + [t + b"a" for t in terms]
        data = np.frombuffer(b"".join(asked), np.uint8)
        ends = np.cumsum([len(a) for a in asked])
        starts = ends - [len(a) for a in asked]
        places = {t: i for i, t in enumerate(terms)}
        assert model.ordinals(data, starts, ends).tolist() == [places.get(a, -1) for a in asked]
        # as many states as there are different sets of endings
        endings = {frozenset(t[len(p):] for t in terms if t.startswith(p)) for t in terms for p in (t[:i] for i in range(len(t) + 1))}
        assert len(model.final) == max(1, len(endings))
