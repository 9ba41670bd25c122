import math
from collections import Counter, defaultdict

import duckdb
import pytest

from effectgrid.llm import url_rules

COLUMNS = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]


def plain(urls, least=5, literals=64, alpha=0.05, prior=10, threshold=0.8, depth=8):
    """The tree by recursion over one host's paths at a time."""
    rows = []
    for url in urls:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else None
        host, path = "", ""
        if rest is not None:
            cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].partition("?")[0].partition("#")[0]
        fits = [r for r in url_rules.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=(None, None, None))
        digits = "".join("#" if c in "0123456789" else c for c in path)
        while "##" in digits:
            digits = digits.replace("##", "#")
        rows.append([host, path, best, [s for s in digits.split("/") if s]])

    def purity(group):
        blocked = sum(r[2][2] == "block" for r in group)
        labelled = sum(r[2][2] is not None for r in group)
        return (blocked + 0.5 * (len(group) - labelled + prior)) / (len(group) + prior)

    out = {}

    def grow(group, node, level):
        rest = [r for r in group if len(r[3]) > level]
        ended = [r for r in group if len(r[3]) <= level]
        for r in ended:
            out[id(r)] = (node, purity(group))
        if level == depth or (len(group) < least):
            for r in rest:
                out[id(r)] = (node + "/**", purity(group))
            return
        seen = Counter(r[3][level] for r in rest)
        token = {s: s if n >= least and n * literals >= len(group) else "*" for s, n in seen.items()}
        branches = defaultdict(list)
        for r in rest:
            branches[token[r[3][level]]].append(r)

        def shares(g):
            return [sum(f(r) for r in g) / len(g) for f in (lambda r: r[2][2] == "block", lambda r: r[2][2] is not None, lambda r: len(r[3]) == level + 1)]

        order = sorted(branches, key=lambda t: ([-s for s in shares(branches[t])], t))
        classes, last = [], None
        for t in order:
            reach = math.sqrt(math.log(2 / alpha) / 2)
            if last is None or any(abs(a - b) > reach * (1 / math.sqrt(len(branches[t])) + 1 / math.sqrt(len(branches[last]))) for a, b in zip(shares(branches[t]), shares(branches[last]))):
                classes.append([])
            classes[-1].append(t)
            last = t
        for names in classes:
            name = "*" if "*" in names else names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}"
            grow([r for t in names for r in branches[t]], node + "/" + name, level + 1)

    for host in {r[0] for r in rows}:
        grow([r for r in rows if r[0] == host], "", 0)
    result = []
    for host, path, (a, b, verdict), tokens in rows:
        template, share = out[id(next(r for r in rows if r[0] is host and r[1] is path and r[3] is tokens))]
        result.append((host, path, None if a is None else a + b, verdict or ("block" if share >= threshold else "allow"), template, round(share, 6)))
    return result


def judge(spark, urls, **options):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return [tuple(r)[1:] for r in sorted(url_rules.judged(pages, **options).select(COLUMNS).collect())]


def test_rules_hosts_and_paths(spark):
    urls = [
        "http://EXAMPLE.com/en/1", "http://www.example.com/en/", "http://a.example.com/en/x", "http://badexample.com/en/", "http://x.net/es/?q", "http://x.net/es",
        "http://com", "http://com/", "no address", None, "", "://", "a://b://c/d", "http://É.net/fr/#x", "http://u@h:80/p?x#y", "http://h?x/y", "http://h#/x",
    ]
    got = judge(spark, urls)
    assert [(g[2], g[3]) for g in got[:8]] == [
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"),
        (None, "allow"), ("com/", "allow"),
    ]
    assert [(g[0], g[1]) for g in got[8:]] == [("", "")] * 4 + [("b:", "//c/d"), ("É.net", "/fr/"), ("u@h:80", "/p"), ("h", ""), ("h", "")]
    assert got == plain(urls)


def test_tree_against_plain(spark):
    urls = [f"http://s.net/{lang}/{i}{'.html' if i % 3 else ''}" for i in range(60) for lang in ("es", "fr", "en", "de")]
    urls += [f"http://s.net/news/{i}/title-{i}-{'abc'[i % 3]}" for i in range(40)] + [f"http://s.net/{chr(97 + i % 26)}{chr(97 + i // 26)}/x" for i in range(300)]
    urls += ["http://s.net" + "/a" * 12] * 30 + [f"http://few.net/es/{i}" for i in range(4)] + [f"http://o.org/{i}" for i in range(3)]
    assert judge(spark, urls) == plain(urls)
    small = {"least": 2, "depth": 2, "literals": 4}
    assert judge(spark, urls, **small) == plain(urls, **small)


def test_template_rejects_what_no_rule_covers(spark):
    urls = [f"http://bad.net/es/{i}" for i in range(200)] + ["http://bad.net/es", "http://bad.net/es"] + [f"http://bad.net/en/{i}" for i in range(200)]
    got = judge(spark, urls)
    assert {g[3] for g in got[202:]} == {"allow"} and got == plain(urls)
    # merged with what is blocked: neighbours that do not differ
    urls = [f"http://bad.net/{a}/{i}" for i in range(200) for a in ("es", "fr")] + ["http://bad.net/es/../x", "http://bad.net/x/7"]
    got = judge(spark, urls)
    assert got[-1][3] == "block" and got[-1][2] is None and got == plain(urls)


def test_empty_repeated_and_long(spark):
    assert judge(spark, []) == []
    urls = ["http://a.org/" + "x/" * 5000, "http://a.org/" + "9" * 100000] * 6 + [None] * 6
    assert judge(spark, urls) == plain(urls)
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://a.com/x")], "page_id long, url string")
    assert [(r.page_id, r.rule) for r in url_rules.judged(pages).collect()].count((1, "com/")) == 2
    assert url_rules.judged(pages).count() == 3


@pytest.mark.parametrize("options", [{}, {"least": 2, "literals": 3, "depth": 3}])
def test_against_sql(spark, options):
    urls = [f"http://{h}/{a}/{i}" for i in range(12) for a in ("es", "en", "x/y", "q/9/r") for h in ("s.net", "t.org", "w.example.com")] + [None, "x"]
    got = judge(spark, urls, **options)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({url_rules.url_sql(**options)})").fetchall(), key=lambda r: r[0]) == [(i, *g) for i, g in enumerate(got)]
