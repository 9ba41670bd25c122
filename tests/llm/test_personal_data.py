import hashlib
import random
import re

import pytest

from effectgrid.llm.personal_data import base_spans, luhn, personal_data, reliabilities, train

SCHEMA = "doc_id long, text string, spans string, n_ip string"


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


PARTS = [
    "a@b.c", "x.y+z@q-r.co.uk", "@", "a@b", "a@b.c@d.e", "é@x.yz", "a@.b", "m@n.o.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.0255",
    "4111111111111111", "4111 1111-1111 1111", "5500 0000 0000 0004 9", "+1 (555) 010-1234", "+49 30 1234567.", "+1", "+12345678901234567", "12", " ", "-",
    ".", "+", "0", "word", "\n", "(", ")", "#", "éà", "99999999999999999999999",
]


def test_strict_spans_against_the_patterns():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(0, 9)))
        assert base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+1" + " " * 300_000, "a.b" * 100_000 + "@", "@" * 100_000, "1.1" * 100_000):
        base_spans(text)


def test_frames(spark):
    texts = [
        None, "", "nothing here", "mail me: a.b@mail1.example.com or call +1 (988) 555-2485", "4539 1488 0343 6467 é 10.20.30.40",
        "contact: jane.doe [at] example [dot] com", "tel. (030) 123 4567, version 1.2.3", "isbn 978 0 306 40615 7", "password=531ccd051a92ebcb68",
    ]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts * 40)]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        base, r = plain(t or ""), got[i]
        named = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone"))
        listed = r.spans.split(",") if r.spans else []
        assert set(named) <= set(listed) and len(listed) == len(named) + r.n_added
    assert got[5].spans == "email:9:40" and got[6].n_added == 1 and got[8].spans == "" and got[7].n_added == 0
    assert personal_data(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_documents(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in personal_data(docs).collect():
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()


def test_expectation_maximisation_finds_the_labelers():
    rng = random.Random(1)
    accuracy, counts = [0.95, 0.9, 0.85, 0.7, 0.5], {}
    for _ in range(4000):
        y = rng.random() < 0.4
        vote = "".join("-" if rng.random() < 0.2 else "yn"[(rng.random() < a) != y] for a in accuracy)
        counts["phone", "local", vote] = counts.get(("phone", "local", vote), 0) + 1
    chance, table = reliabilities(counts)
    for j, a in enumerate(accuracy):
        for y in (0, 1):
            right = table[j, y, 0 if y else 1] / table[j, y, :2].sum()
            assert right == pytest.approx(a, abs=0.05)
    assert chance["phone", "local", "yyyyy"] > 0.95 > 0.05 > chance["phone", "local", "nnnnn"]
    assert not train({}).any()
