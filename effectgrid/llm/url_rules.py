"""URL filters: stated rules, and a tree of path templates per host for what no rule covers.

A path is cut at its slashes and runs of digits become `#`, which makes variable
segments of numbers one. The tree of a host is then grown level by level. At a
node a segment stays literal if it holds a 64th of the node's pages and at least
`least` of them; all others become the wildcard `*`, so a node has at most 65
branches. Branches under one node are put in order of the shares of blocked,
labelled and ending pages; neighbours in that order whose shares do not differ by
Hoeffding's bound are merged, as in state merging of automata. A template is the
path of merged branches from the host on.

Pages that a rule covers are the labelled ones. The purity of a template is the
share of its blocked pages; a page without a label, and `prior` pages more, count
half. Templates at `threshold` or more are rejected: most of their pages are blocked.

DataFrame functions only. The tree is grown on the distinct (host, path) with
their counts, and no window spans more than the branches of one node.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectgrid.llm.tables import stored

#: Host, path and verdict. Fixed by the task.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
LEAST = 5
LITERALS = 64
ALPHA = 0.05
PRIOR = 10
THRESHOLD = 0.8
DEPTH = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BRANCH = ["host", "node", "token"]


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_length(rules) -> list[tuple[str, str, str]]:
    """The longest host and path first; of equal ones the longer host, then by text."""
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))


def fitting(host: Column, path: Column, rules, value) -> Column:
    """The value of the longest rule whose host (or a subdomain of it) and path fit; null if none."""
    out = F.lit(None).cast("string")
    for rule in reversed(by_length(rules)):
        own = (host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))
        out = F.when(own & F.startswith(path, F.lit(rule[1])), F.lit(value(rule))).otherwise(out)
    return out


def branch_key(path: Column) -> Column:
    """The path's segments, runs of digits as `#`, without empty segments."""
    return F.array_join(F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != ""), "/")


def judged_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, ruled (its verdict) and key (the generalised path)."""
    url = F.col(f"`{url_column}`").cast("string")
    rows = pages.select(F.col(f"`{id_column}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    return rows.select(
        "id",
        "host",
        "path",
        fitting(host, path, rules, lambda r: r[0] + r[1]).alias("rule"),
        fitting(host, path, rules, lambda r: r[2]).alias("ruled"),
        branch_key(path).alias("key"),
    )


def _counts() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("pages", "blocked", "labelled")]


def _purity(prior: float) -> Column:
    return (F.col("blocked") + 0.5 * (F.col("pages") - F.col("labelled") + prior)) / (F.col("pages") + prior)


def _merged(branches: DataFrame, alpha: float, prior: float) -> DataFrame:
    """The branches of each node with the class that they are merged into: its name, pages and purity."""
    share = {c: F.col(c) / F.col("pages") for c in ("blocked", "labelled", "ends")}
    rows = branches.withColumns({f"{c}_share": s for c, s in share.items()})
    order = Window.partitionBy("host", "node").orderBy(F.desc("blocked_share"), F.desc("labelled_share"), F.desc("ends_share"), "token")
    reach = math.sqrt(math.log(2 / alpha) / 2)
    apart = F.lit(False)
    for c in share:
        bound = F.lit(reach) * (1 / F.sqrt(F.col("pages")) + 1 / F.sqrt(F.lag("pages").over(order)))
        apart = apart | (F.abs(F.col(f"{c}_share") - F.lag(f"{c}_share").over(order)) > bound)
    rows = rows.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    rows = rows.withColumn("class", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # at most 65 branches a node, so at most as many names in a class
    whole = Window.partitionBy("host", "node", "class")
    names = F.sort_array(F.collect_list("token").over(whole))
    rows = rows.withColumn("names", names).withColumns({c: F.sum(c).over(whole) for c in ("pages", "blocked", "labelled")})
    name = (
        F.when(F.array_contains("names", "*"), F.lit("*"))
        .when(F.size("names") == 1, F.col("names")[0])
        .otherwise(F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}")))
    )
    return rows.select(
        "host", "node", "token", F.concat("node", F.lit("/"), name).alias("child"), F.col("pages").alias("child_pages"),
        _purity(prior).alias("child_purity"),
    )


def template_tree(
    urls: DataFrame, least: int = LEAST, literals: int = LITERALS, alpha: float = ALPHA, prior: float = PRIOR, depth: int = DEPTH
) -> DataFrame:
    """(host, key) -> template and purity, from rows of (host, key, ruled).

    A node with fewer than `least` pages is not grown further, nor is one at
    `depth`; what lies below belongs to it, as `/**`.
    """
    labelled = F.col("ruled").isNotNull().cast("long")
    blocked = F.coalesce((F.col("ruled") == "block").cast("long"), F.lit(0).cast("long"))
    paths = stored(
        urls.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"), F.sum(blocked).alias("blocked"), F.sum(labelled).alias("labelled"))
    )
    segments = F.when(F.col("key") == "", F.lit(0)).otherwise(F.size(F.split("key", "/")))
    deepest = paths.agg(F.max(segments)).first()[0] or 0
    hosts = paths.groupBy("host").agg(*_counts())
    hosts = hosts.select("host", F.col("pages").alias("node_pages"), _purity(prior).alias("purity"))
    tree = paths.join(hosts, "host").withColumn("node", F.lit("")).withColumn("segments", segments)
    tree = stored(tree.withColumn("grows", F.col("node_pages") >= least).withColumn("used", F.lit(0)))
    for level in range(1, min(deepest, depth) + 1):
        open_ = F.col("grows") & (F.col("segments") >= level)
        rows = tree.where(open_).withColumn("segment", F.split("key", "/")[level - 1])
        ends = F.when(F.col("segments") == level, F.col("pages")).otherwise(0)
        seen = rows.groupBy("host", "node", "node_pages", "segment").agg(*_counts(), F.sum(ends).alias("ends"))
        literal = (F.col("pages") >= least) & (F.col("pages") * literals >= F.col("node_pages"))
        seen = stored(seen.withColumn("token", F.when(literal, F.col("segment")).otherwise("*")))
        branches = seen.groupBy("host", "node", "token").agg(*_counts(), F.sum("ends").alias("ends"))
        merged = _merged(branches, alpha, prior)
        found = seen.select("host", "node", "segment", "token").join(merged, BRANCH).drop("token")
        keys = ["host", "node", "segment"]
        grown = tree.withColumn("segment", F.when(open_, F.split("key", "/")[level - 1])).join(found, keys, "left")
        moved = F.col("child").isNotNull()
        tree = stored(
            grown.select(
                "host", "key", "pages", "blocked", "labelled", "segments",
                F.coalesce("child", "node").alias("node"),
                F.coalesce("child_pages", "node_pages").alias("node_pages"),
                F.coalesce("child_purity", "purity").alias("purity"),
                (moved & (F.col("child_pages") >= least)).alias("grows"),
                # segments of the path that the template has used
                F.when(moved, F.lit(level)).otherwise(F.col("used")).alias("used"),
            )
        )
    template = F.concat("node", F.when(F.col("segments") > F.col("used"), F.lit("/**")).otherwise(F.lit("")))
    return tree.select("host", "key", template.alias("template"), "purity")


def judged(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, threshold: float = THRESHOLD, **tree
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, purity.

    The verdict is the rule's where one fits (a short list, the longest wins),
    else `block` if the page's template is rejected, else `allow`. A url that is
    null or has no `://` has an empty host and path; its template is that of the
    empty host. Repeated ids and repeated rows are judged one by one, and each
    counts in its templates. An empty table gives an empty result; other columns
    are not read.
    """
    urls = stored(judged_urls(pages, id_column, url_column, rules))
    found = urls.join(template_tree(urls, **tree), ["host", "key"])
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return found.select(F.col("id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


_TAIL = """SELECT t.page_id, t.host, t.path, t.rule,
  coalesce(t.ruled, CASE WHEN p.purity >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict,
  p.node || CASE WHEN p.segments > p.used THEN '/**' ELSE '' END AS template, round(p.purity, 6) AS purity
FROM t JOIN p{depth} p USING (host, key)"""


def url_sql(rules=RULES, least=LEAST, literals=LITERALS, alpha=ALPHA, prior=PRIOR, threshold=THRESHOLD, depth=DEPTH) -> str:
    """The rows of `judged` in DuckDB: one stage of the tree after the other."""

    def case(value) -> str:
        whens = "".join(
            f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((h, p, v))}'" for h, p, v in by_length(rules)
        )
        return f"CASE{whens} END"

    apart = " OR ".join(
        f"abs({c} / pages - lag({c} / pages) OVER o) > {math.sqrt(math.log(2 / alpha) / 2)!r} * (1 / sqrt(pages) + 1 / sqrt(lag(pages) OVER o))"
        for c in ("blocked", "labelled", "ends")
    )
    out = rf"""
WITH u AS MATERIALIZED (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
),
t AS MATERIALIZED (
  SELECT *, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS ruled,
    array_to_string(list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda s: s <> ''), '/') AS key FROM u
),
k AS MATERIALIZED (
  SELECT host, key, CASE WHEN key = '' THEN 0 ELSE len(string_split(key, '/')) END AS segments,
    count(*) AS pages, count(*) FILTER (ruled = 'block') AS blocked, count(ruled) AS labelled FROM t GROUP BY ALL
),
hosts AS (
  SELECT host, sum(pages) AS node_pages, (sum(blocked) + 0.5::DOUBLE * (sum(pages) - sum(labelled) + {prior})) / (sum(pages) + {prior}) AS purity
  FROM k GROUP BY host
),
p0 AS MATERIALIZED (SELECT k.*, '' AS node, node_pages, purity, node_pages >= {least} AS grows, 0 AS used FROM k JOIN hosts USING (host)),"""
    for i in range(1, depth + 1):
        out += rf"""
s{i} AS MATERIALIZED (
  SELECT host, node, node_pages, string_split(key, '/')[{i}] AS segment, sum(pages) AS pages, sum(blocked) AS blocked,
    sum(labelled) AS labelled, sum(CASE WHEN segments = {i} THEN pages ELSE 0 END) AS ends
  FROM p{i - 1} WHERE grows AND segments >= {i} GROUP BY ALL
),
l{i} AS MATERIALIZED (SELECT *, CASE WHEN pages >= {least} AND pages * {literals} >= node_pages THEN segment ELSE '*' END AS token FROM s{i}),
b{i} AS (
  SELECT host, node, token, sum(pages) AS pages, sum(blocked) AS blocked, sum(labelled) AS labelled, sum(ends) AS ends FROM l{i} GROUP BY ALL
),
a{i} AS (
  SELECT *, CASE WHEN coalesce({apart}, FALSE) THEN 1 ELSE 0 END AS apart FROM b{i}
  WINDOW o AS (PARTITION BY host, node ORDER BY blocked / pages DESC, labelled / pages DESC, ends / pages DESC, token)
),
c{i} AS (
  SELECT *, sum(apart) OVER (PARTITION BY host, node ORDER BY blocked / pages DESC, labelled / pages DESC, ends / pages DESC, token ROWS UNBOUNDED PRECEDING) AS class FROM a{i}
),
m{i} AS MATERIALIZED (
  SELECT host, node, list_sort(list(token)) AS names, sum(pages) AS child_pages,
    (sum(blocked) + 0.5::DOUBLE * (sum(pages) - sum(labelled) + {prior})) / (sum(pages) + {prior}) AS child_purity
  FROM c{i} GROUP BY host, node, class
),
f{i} AS (
  SELECT l.host, l.node, l.segment, child_pages, child_purity, l.node || '/' || CASE WHEN list_contains(names, '*') THEN '*'
    WHEN len(names) = 1 THEN names[1] ELSE '{{' || array_to_string(names, '|') || '}}' END AS child
  FROM l{i} l JOIN m{i} m ON l.host = m.host AND l.node = m.node AND list_contains(names, l.token)
),
p{i} AS MATERIALIZED (
  SELECT p.host, p.key, p.segments, p.pages, p.blocked, p.labelled, coalesce(child, p.node) AS node, coalesce(child_pages, p.node_pages) AS node_pages,
    coalesce(child_purity, p.purity) AS purity, child IS NOT NULL AND child_pages >= {least} AS grows, CASE WHEN child IS NOT NULL THEN {i} ELSE p.used END AS used
  FROM p{i - 1} p LEFT JOIN f{i} f ON p.grows AND p.segments >= {i} AND p.host = f.host AND p.node = f.node AND string_split(p.key, '/')[{i}] = f.segment
),"""
    return out.rstrip(",") + "\n" + _TAIL.format(threshold=threshold, depth=depth)
