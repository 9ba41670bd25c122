"""The pipeline on all documents of a small table against a plain version of each stage."""

import duckdb
import pytest

import corpus_pipeline
from effectgrid.llm.language import BUCKETS, LANGUAGES, LEAST_POSTERIOR, STRENGTH, TEMPER, document_rows, identify
from effectgrid.llm.oracle import classes_sql, contamination_sql, copies_sql, mixing_sql

LETTERS = set(range(97, 123))


def plain_language(docs):
    """docs: (id, text, declared, source). The fused posterior row by row, with plain loops."""
    from math import exp, log

    def grams(text):
        b = (text or "").encode()
        b = bytes(x + 32 if 65 <= x <= 90 else x for x in b)
        b = [x if x > 127 or x in LETTERS else 32 for x in b]
        out = []
        for i in range(len(b) - 2):
            if b[i : i + 3] != [32, 32, 32]:
                code = b[i] << 16 | b[i + 1] << 8 | b[i + 2]
                out.append((code * 2654435761 % 2**32) >> 20)
        return out

    n = len(LANGUAGES)
    table = [[0.5] * BUCKETS for _ in LANGUAGES]
    rows = [(i, grams(t), (d or "")[:2].lower() or None, s) for i, t, d, s in docs]
    for _, g, d, _ in rows:
        if d in LANGUAGES:
            for x in g:
                table[LANGUAGES.index(d)][x] += 1
    logs = [[log(x / sum(t)) for x in t] for t in table]

    def soft(v):
        e = [exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    text = [[TEMPER * sum(logs[k][x] for x in g) for k in range(n)] for _, g, _, _ in rows]
    p = [soft(v) for v in text]

    def sums(column):
        out = {}
        for r, q in zip(rows, p):
            if r[1] and r[column] is not None:
                c, s = out.setdefault(r[column], (0, [0.0] * n))
                out[r[column]] = (c + 1, [a + b for a, b in zip(s, q)])
        return out

    declared, hosts = sums(2), sums(3)
    whole = (sum(bool(r[1]) for r in rows), [sum(q[k] for r, q in zip(rows, p) if r[1]) for k in range(n)])
    totals = [sum(s[k] for _, s in declared.values()) for k in range(n)]
    result = {}
    for r, v, q in zip(rows, text, p):
        own = 1.0 if r[1] else 0.0

        def smooth(level, above):
            c, s = level
            return [(max(0.0, s[k] - q[k] * own) + STRENGTH * above[k]) / (max(0.0, c - own) + STRENGTH) for k in range(n)]

        prior = smooth(whole, [1 / n] * n)
        if r[3] is not None:
            prior = smooth(hosts.get(r[3], (0, [0.0] * n)), prior)
        other = [log(x) for x in prior]
        if r[2] in declared:
            other = [o + log((declared[r[2]][1][k] + 1) / (totals[k] + len(declared) + 1)) for k, o in enumerate(other)]
        fused = [a + b for a, b in zip(v, other)]
        fused.append(-TEMPER * len(r[1]) * log(BUCKETS) + sum(other) / n - log(10))
        post = soft(fused)
        best = post.index(max(post))
        result[r[0]] = (LANGUAGES[best] if best < n and post[best] >= LEAST_POSTERIOR else None, post[best])
    return result


ODD = [
    (9001, None, "en", "src1", 0),
    (9002, "", None, None, 0),
    (9003, "ひらがなとカタカナと漢字の文章です。" * 20, "en", "src2", 0),
    (9004, "ok", "xx", None, 2),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    folder = tmp_path_factory.mktemp("corpus")
    given.unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_language_against_plain_version(spark, docs):
    rows = spark.read.parquet(f"{docs}/documents.parquet")
    got = {r.key: (r.language, r.posterior) for r in identify(document_rows(rows)).collect()}
    expected = plain_language([tuple(r) for r in rows.select("doc_id", "text", "lang", "source").collect()])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(abs(got[k][1] - expected[k][1]) < 2e-6 for k in got)
    assert got[9003][0] is None and got[9001][0] == "en"


def test_pipeline_against_plain_stages(spark, docs):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{docs}/{t}.parquet/*.parquet'")
    known = plain_language(con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall())
    ids = [i for i, (x, _) in known.items() if x]
    con.execute(f"CREATE TABLE s1 AS SELECT * FROM documents WHERE doc_id IN ({','.join(map(str, ids))})")
    con.execute(f"CREATE TABLE s2 AS SELECT * FROM s1 WHERE doc_id IN (SELECT doc_id FROM ({copies_sql('s1')}) WHERE kept)")
    con.execute(f"CREATE TABLE s3 AS SELECT * FROM s2 WHERE doc_id IN (SELECT doc_id FROM ({classes_sql('s2')}) WHERE doc_id = component_id)")
    con.execute(f"CREATE TABLE s4 AS SELECT * FROM s3 WHERE doc_id NOT IN (SELECT doc_id FROM ({contamination_sql('s3')}) WHERE contaminated)")
    taken = dict(con.execute(f"SELECT doc_id, taken / size FROM ({mixing_sql('s4')}) WHERE taken > 0").fetchall())
    counts = [con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("documents", "s1", "s2", "s3", "s4")]
    assert counts[0] > counts[1] and counts[1] > counts[2] >= counts[3] > counts[4] > 0
    rows = corpus_pipeline.run(spark, docs).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == taken
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert all(r.text == texts[r.doc_id] for r in rows)
    assert len({(r.doc_id, r.mix_pass) for r in rows}) == len(rows)


def test_stages_keep_the_columns(spark, docs):
    rows = spark.read.parquet(f"{docs}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, docs).columns == rows.columns
    empty = rows.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, docs).collect() == []


def test_stages_keep_rows_without_an_id(spark):
    from effectgrid.llm import decontaminate, exact_dedup, language, ngram_join

    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(None, texts[0], "en", "s", 1), (None, texts[1], "en", "s", 1), (3, texts[2], "en", "s", 1), (3, texts[2], "en", "s", 1), (4, texts[3], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "item_id long, text string")
    same = sorted(map(str, docs.collect()))
    for stage in (exact_dedup.without_copies, ngram_join.one_of_each, lambda d: decontaminate.decontaminated(d, none), language.in_known_language):
        assert sorted(map(str, stage(docs).collect())) == same


def test_languages_come_from_the_declared_codes(spark):
    from effectgrid.llm import language

    english = [(i, f"the cat and the dog went to the house number {i} on the hill", "en") for i in range(200)]
    japanese = [(1000 + i, f"私は猫と犬が好きです。家は丘の上に{i}あります。", "ja") for i in range(200)]
    docs = spark.createDataFrame([(i, t, c, "s", 1) for i, t, c in english + japanese], "doc_id long, text string, lang string, source string, n_chars long")
    assert language.known_languages(language.document_rows(docs)) == ("de", "en", "es", "fr", "ja")
    found = {r.key: r.language for r in language.identify(language.document_rows(docs)).collect()}
    assert sum(found[i] == c for i, _, c in english + japanese) >= 392
    assert language.in_known_language(docs).count() >= 396


def test_a_source_named_like_a_marker_stays_apart(spark):
    from effectgrid.llm import mixing

    rows = [(i, "w " * 3, s) for i, s in enumerate([None, "null", "\0", "=", "=null"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    assert {r.source_size for r in got} == {12} and all(r.taken <= 3 * r.size for r in got)
