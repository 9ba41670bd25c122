import duckdb
import pytest

from effectgrid.llm import mixing
from effectgrid.llm.oracle import mixing_sql

SCHEMA = "doc_id long, text string, source string"


def of_sizes(spark, sizes):
    """sizes: (id, source, number of words)."""
    return spark.createDataFrame([(i, "w " * n, s) for i, s, n in sizes], SCHEMA)


def long_among_short(start, long, short, target):
    """Source b: one long document and short ones of ten words; a makes b's share of all words its target."""
    rows = [(start + i, "b", 10) for i in range(short)] + [(start + short, "b", long)]
    # weights 5 and 2: b's target is two sevenths of all words
    other = round(target * 7 / 2) - long - 10 * short
    return rows + [(start + short + 1 + i, "a", 1000) for i in range(other // 1000)] + [(start - 1, "a", other % 1000 + 1)]


@pytest.mark.parametrize("start", [50_001])
@pytest.mark.parametrize("long, short, target", [(20_000, 2_499, 21_423), (30_000, 999, 19_994)])
def test_a_long_document_does_not_move_the_target(spark, start, long, short, target):
    rows = long_among_short(start, long, short, target)
    source_of = {i: s for i, s, _ in rows}
    got = mixing.mixed(of_sizes(spark, rows)).collect()
    assert all(r.taken <= 3 * r["size"] for r in got)
    for source in "ab":
        own = [r for r in got if source_of[r.doc_id] == source]
        print(source, own[0].target, sum(r.taken for r in own))
        assert abs(sum(r.taken for r in own) - own[0].target) <= (10 if source == "b" else 1000)


def plain_fill(rows, target):
    """rows: (id, size, block, u). Words taken by id: whole passes, each copy that fits in its turn, then the nearest."""
    total = sum(size for _, size, _, _ in rows)
    passes = int(target / total + 1e-9) if total else 0
    taken = {i: passes * size for i, size, _, _ in rows}
    gap, used = int(max(0, target - passes * total) + 1e-6), set()
    order = sorted((r for r in rows if r[1]), key=lambda r: (r[2], r[3], r[0]))
    for _ in range(passes, 3):
        for i, size, _, _ in order:
            if size <= gap:
                gap -= size
                taken[i] += size
                used.add(i)
    near = [(abs(size - gap), u, i, size) for i, size, _, u in order if i not in used and abs(size - gap) < gap]
    if near and passes < 3:
        _, _, i, size = min(near)
        taken[i] += size
    return taken


def test_fill_against_a_plain_loop_and_sql(spark):
    import hashlib
    from math import ceil, floor

    sizes = [(i, s, n) for k, s in enumerate(["x", "y", None, "z"]) for i, n in
             ((1000 * k + j, (j * j * 37 + k) % (900 if j % 9 else 9000)) for j in range(1, 30 * (k + 1)))]
    docs = of_sizes(spark, sizes)
    got = {r.doc_id: r for r in mixing.mixed(docs, block_words=2000, shard_words=100_000).collect()}
    for source in {s for _, s, _ in sizes}:
        own = [(i, n) for i, s, n in sizes if s == source]
        total = sum(n for _, n in own)
        blocks = max(1, ceil(total / 2000))
        rows = []
        for i, n in own:
            u = int(hashlib.md5(f"block/{i}".encode()).hexdigest()[:8], 16) / 2**32
            rows.append((i, n, floor(u * blocks), u))
        want = plain_fill(rows, got[own[0][0]].target)
        assert {i: got[i].taken for i, _ in own} == want
        assert all(len(got[i].shards) * n == got[i].taken for i, n in own)
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    sql = {r[0]: r[4] for r in con.execute(mixing_sql("documents", 2000)).fetchall()}
    assert sql == {i: r.taken for i, r in got.items()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, "w w", "a"), (3, "w", "a")], SCHEMA)
    got = {r.doc_id: (r["size"], r.taken) for r in mixing.mixed(docs).collect()}
    assert got[1] == (0, 0) and got[2] == (0, 0) and got[None] == (2, 0) and got[3][1] <= 3
    assert mixing.mixed(docs.limit(0)).collect() == []
    assert mixing.mix(docs.limit(0)).collect() == []


def test_later_rounds_get_only_what_is_within_reach(spark, monkeypatch):
    # the eleventh document is longer than what is then missing, all others would fit
    sizes = [250 if i == 10 else 7 + i % 5 for i in range(1500)]
    rows = [("=a", i, n, (i % 150) / 150, i // 150, 10, 0, 300.0) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "key string, id long, size long, u double, block long, blocks long, passes int, part double")
    first, rounds = mixing.first_that_fit, []

    def counted(open_rows):
        rounds.append([(r.gap, r["size"]) for r in open_rows.select("gap", "size").collect()])
        return first(open_rows)

    monkeypatch.setattr(mixing, "first_that_fit", counted)
    draws, _ = mixing.fill(docs)
    got = sorted((r["pass"], r.id) for r in draws.collect())
    gap, want = 300, []
    for turn in range(3):
        for i, n in enumerate(sizes):
            if n <= gap:
                gap -= n
                want.append((turn, i))
    near = [(abs(n - gap), i) for i, n in enumerate(sizes) if abs(n - gap) < gap and i not in {i for _, i in want}]
    assert got == sorted(want + [(0, i) for _, i in near[:1]])
    assert len(rounds[0]) == 4500
    missing = 300 - sum(sizes[:10])
    assert {gap for gap, _ in rounds[1]} == {missing}
    assert 0 < len(rounds[1]) <= sum(missing // n for n in set(sizes))
