"""Equivalent SQL of the queries, for an independent engine on the same tables."""

from __future__ import annotations

from effectgrid.sources.views import SCORE_COLUMNS
from effectgrid.plans.oracle_mixed import normal_tail, random_intercept_sql
from effectgrid.study import TABLES_STUDY as S


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _values(values) -> str:
    return ", ".join(f"('{v}')" for v in values)


LEVELS = _list(S.cell_levels)
CELL_CASE = " ".join(f"WHEN starts_with(celltype, '{c}') THEN '{c}'" for c in S.cell_levels)

EFFECTS = f"""
effects_v AS (
  SELECT CAST(l_partkey AS VARCHAR) AS gene, c_mktsegment || '.' || l_returnflag AS celltype,
         'prio_' || substr(o_orderpriority, 1, 1) || '.scaled' AS pathology,
         CASE WHEN l_linestatus = 'F' THEN 'Female' ELSE 'Male' END AS sex,
         round(l_discount - l_tax, 2) AS "logFC", l_quantity / 50 AS adj_p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
effects_c AS (
  SELECT gene, celltype, lower(sex) AS sex, "logFC", adj_p,
         regexp_replace(pathology, '\\.scaled$', '') AS path_short,
         replace(celltype, '.', '_') AS cell_clean,
         CASE {CELL_CASE} ELSE replace(celltype, '.', '_') END AS cell_major
  FROM effects_v
),
annotated AS (
  SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS symbol FROM part WHERE p_brand IN ({_list(S.terms)})
),
prefixed AS (SELECT DISTINCT gene AS symbol FROM effects_v WHERE regexp_matches(gene, '{S.prefix}')),
combined AS (SELECT symbol FROM annotated UNION SELECT symbol FROM prefixed),
in_set AS (SELECT * FROM effects_c WHERE gene IN (SELECT symbol FROM combined)),
sig AS (
  SELECT gene, CASE WHEN cell_major IN ({LEVELS}) THEN cell_major END AS cell_major,
         path_short, sex, "logFC", adj_p
  FROM in_set
  WHERE adj_p < {S.alpha} AND abs("logFC") >= {S.lfc_min} AND path_short IN ({_list(S.pathologies)})
)"""

LEVEL_TABLE = f"levels AS (SELECT cell_major FROM (VALUES {_values(S.cell_levels)}) t(cell_major))"

CELL_PATH = f"""{EFFECTS}, {LEVEL_TABLE},
counted AS (
  SELECT cell_major, path_short, count(DISTINCT gene) AS n_sig, median("logFC") AS med_lfc
  FROM sig WHERE cell_major IS NOT NULL GROUP BY ALL
),
grid AS (
  SELECT l.cell_major, p.path_short, coalesce(c.n_sig, 0) AS n_sig, c.med_lfc
  FROM levels l CROSS JOIN (SELECT DISTINCT path_short FROM sig) p
  LEFT JOIN counted c ON c.cell_major = l.cell_major AND c.path_short = p.path_short
)"""


def _clamp(expr: str, cap: float) -> str:
    return f"CASE WHEN {expr} IS NOT NULL THEN least(greatest({expr}, -{cap}), {cap}) END"


RECUR = f"""{EFFECTS},
recur AS (
  SELECT cell_major, gene, count(DISTINCT path_short) AS n_path,
         count(DISTINCT CASE WHEN "logFC" > 0 THEN path_short END) AS pos,
         count(DISTINCT CASE WHEN "logFC" < 0 THEN path_short END) AS neg
  FROM sig GROUP BY ALL HAVING count(DISTINCT path_short) >= {S.min_recur}
)"""


def _fisher(source: str, a: str, b: str, c: str, d: str) -> str:
    """CTE body: every row of `source` with its two-sided p."""
    ln_weight = (
        "-(lgamma({k} + 1) + lgamma(row1 - {k} + 1) + lgamma(col1 - {k} + 1)"
        " + lgamma(row2 - col1 + {k} + 1))"
    )
    return f"""
margins AS (
  SELECT *, {a} + {b} AS row1, {c} + {d} AS row2, {a} + {c} AS col1,
         greatest(0, {a} + {c} - {c} - {d}) AS low, least({a} + {c}, {a} + {b}) AS high
  FROM {source}
),
support AS (
  SELECT *, exp({ln_weight.format(k='k')} - {ln_weight.format(k=a)}) AS w
  FROM (SELECT *, unnest(range(CAST(low AS BIGINT), CAST(high AS BIGINT) + 1)) AS k FROM margins) s
),
tested AS (
  SELECT m.*, s.p FROM margins m JOIN (
    SELECT cell_major, least(1.0, sum(CASE WHEN w <= 1 + 1e-7 THEN w END) / sum(w)) AS p
    FROM support GROUP BY cell_major
  ) s ON m.cell_major IS NOT DISTINCT FROM s.cell_major
)"""


MATRIX = f"""{EFFECTS},
cells AS (
  SELECT gene, cell_major || '|' || sex AS col_key, nullif(median("logFC"), 0) AS v
  FROM in_set
  WHERE adj_p < {S.alpha} AND abs("logFC") >= {S.lfc_min} AND path_short = '{S.matrix_path}'
  GROUP BY gene, sex, cell_major
),
best AS (
  SELECT gene FROM cells WHERE v IS NOT NULL GROUP BY gene HAVING count(v) >= 2
  ORDER BY round(var_samp(v), 12) DESC, gene LIMIT {S.matrix_rows}
),
mat AS (
  SELECT gene, col_key, {_clamp('v', S.matrix_cap)} AS v FROM cells
  WHERE v IS NOT NULL AND gene IN (SELECT gene FROM best)
)"""

VECTORS = f"""
long AS (
  SELECT CAST(vec_id AS VARCHAR) AS item, CAST(pos AS VARCHAR) AS dim,
         CASE WHEN abs(v) >= CAST(0.03 AS DOUBLE) THEN CAST(v AS DOUBLE) END AS v
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) e
),
best AS (
  SELECT item FROM long WHERE v IS NOT NULL GROUP BY item HAVING count(v) >= 2
  ORDER BY round(var_samp(v), 12) DESC, item LIMIT {S.matrix_rows}
),
mat AS (
  SELECT item, dim, {_clamp('v', 0.3)} AS v FROM long
  WHERE v IS NOT NULL AND item IN (SELECT item FROM best)
)"""


def _distance(ctes: str, item: str, dim: str) -> str:
    return f"""WITH {ctes},
names AS (SELECT DISTINCT {item} AS i FROM mat),
moments AS (
  SELECT x.{item} AS a, y.{item} AS b, covar_samp(x.v, y.v) AS xy,
         var_samp(x.v) AS xx, var_samp(y.v) AS yy
  FROM mat x JOIN mat y ON x.{dim} = y.{dim} AND x.{item} < y.{item} GROUP BY ALL
)
SELECT p.i AS a, q.i AS b,
       round(CASE WHEN xx > 0 AND yy > 0
                  THEN 1 - least(greatest(xy / (sqrt(xx) * sqrt(yy)), -1), 1) ELSE 1 END, 6) AS dist
FROM names p JOIN names q ON p.i < q.i LEFT JOIN moments m ON m.a = p.i AND m.b = q.i"""


PHENOS = ["prio_1", "prio_2", "prio_3", "prio_4", "prio_5", "acctbal"]
_PRIO = ", ".join(
    f"avg(CASE WHEN starts_with(o_orderpriority, '{i}') THEN o_totalprice END) AS prio_{i}"
    for i in range(1, 6)
)
QC = ["pct_counts_mt", "total_counts"]
OBS = f"""
donors AS (SELECT o_custkey, {_PRIO} FROM orders GROUP BY o_custkey),
obs_v AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS projid,
         CASE WHEN c_mktsegment IN ({LEVELS}) THEN c_mktsegment END AS cell_major,
         CASE WHEN c_nationkey % 2 = 1 THEN 'male' ELSE 'female' END AS sex,
         l_quantity AS pct_counts_mt, l_linenumber AS total_counts,
         l_extendedprice AS "REACTOME_PRICE", l_discount AS "GOBP_DISCOUNT", l_tax AS "WP_TAX",
         l_extendedprice / nullif(l_quantity, 0) AS "KEGG_UNIT_PRICE",
         l_extendedprice / nullif(o_totalprice, 0) AS "GOCC_ORDER_SHARE",
         l_linenumber AS "MOOTHA_MITOPHAGY",
         prio_1, prio_2, prio_3, prio_4, prio_5, c_acctbal AS acctbal
  FROM lineitem JOIN orders o ON l_orderkey = o_orderkey
  JOIN customer ON o.o_custkey = c_custkey JOIN donors d ON d.o_custkey = o.o_custkey
)"""
_BULK_COLUMNS = SCORE_COLUMNS + QC
BULK = f"""{OBS},
pb AS (
  SELECT projid, cell_major, sex,
         {', '.join(f'CAST(median("{c}") AS DOUBLE) AS "{c}"' for c in _BULK_COLUMNS)}
  FROM obs_v GROUP BY projid, cell_major, sex
),
pheno AS (SELECT DISTINCT projid, {', '.join(PHENOS)} FROM obs_v),
bulk AS (SELECT pb.*, {', '.join(f'pheno.{c}' for c in PHENOS)} FROM pb LEFT JOIN pheno USING (projid))"""


def t_tail(t: str, nu: str) -> str:
    """Two-sided Student-t tail as a power series of the incomplete beta function."""
    a = f"({nu} / 2.0)"
    ln_beta = f"(lgamma({a}) + lgamma(0.5) - lgamma({a} + 0.5))"
    x, y = f"({nu} / ({nu} + {t} * {t}))", f"({t} * {t} / ({nu} + {t} * {t}))"
    front = f"exp({a} * ln({x}) + 0.5 * ln({y}) - {ln_beta})"

    def series(first: str, second: str, at: str, terms: int) -> str:
        ratio = f"{at} * ({first} + {second} + j) / ({first} + 1 + j)"
        return (
            f"list_reduce(list_prepend(CAST(1 AS DOUBLE), list_transform(range({terms - 1}, -1, -1), "
            f"lambda i: CAST(i AS DOUBLE))), lambda acc, j: 1 + {ratio} * acc)"
        )

    far = f"{front} / {a} * {series(a, '0.5', x, 1500)}"
    near = f"1 - {front} / 0.5 * {series('0.5', a, y, 400)}"
    return f"CASE WHEN {t} * {t} > 9 THEN {far} ELSE {near} END"


def _pairs(names, source: str = "b") -> str:
    return ", ".join(f"('{n}', {source}.\"{n}\")" for n in names)


# least squares by residuals (y and x each regressed on z first)
ASSOC = f"""{BULK},
panels AS (
  SELECT *, count(*) OVER (PARTITION BY cell_major, sex) AS n_obs FROM bulk
  WHERE cell_major IN ({LEVELS})
),
ids AS (SELECT cell_major, sex, count(DISTINCT projid) AS n_id FROM bulk GROUP BY ALL),
long AS (
  SELECT b.cell_major, b.sex, b.n_obs, r.pathway, p.predictor, r.y, p.x, b.pct_counts_mt AS z
  FROM panels b, LATERAL (VALUES {_pairs(SCORE_COLUMNS)}) r(pathway, y),
       LATERAL (VALUES {_pairs(PHENOS)}) p(predictor, x)
  WHERE b.n_obs >= {S.min_n}
),
scaled AS (
  SELECT *, stddev_samp(x) OVER g AS sd_x FROM long
  WINDOW g AS (PARTITION BY cell_major, sex, pathway, predictor)
),
slopes AS (
  SELECT cell_major, sex, pathway, predictor, any_value(n_obs) AS n_obs, any_value(sd_x) AS sd_x,
         count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz,
         regr_slope(x, z) AS xz, regr_slope(y, z) AS yz
  FROM scaled WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND sd_x > 0 GROUP BY ALL
),
resid AS (
  SELECT s.*, l.x - mx - xz * (l.z - mz) AS rx, l.y - my - yz * (l.z - mz) AS ry
  FROM long l JOIN slopes s USING (cell_major, sex, pathway, predictor)
  WHERE l.x IS NOT NULL AND l.y IS NOT NULL AND l.z IS NOT NULL
),
beta AS (
  SELECT cell_major, sex, pathway, predictor, n_obs, sd_x, n,
         sum(rx * ry) / sum(rx * rx) AS b, sum(rx * rx) AS sxx
  FROM resid GROUP BY ALL
),
rss AS (
  SELECT r.cell_major, r.sex, r.pathway, r.predictor, sum((ry - b * rx) ** 2) AS rss
  FROM resid r JOIN beta e USING (cell_major, sex, pathway, predictor) GROUP BY ALL
),
terms AS (
  SELECT e.*, b * sd_x AS estimate, sqrt(rss / (n - 3) / sxx) * sd_x AS std_error,
         b / sqrt(rss / (n - 3) / sxx) AS t
  FROM beta e JOIN rss USING (cell_major, sex, pathway, predictor)
),
fits AS (
  SELECT cell_major, sex, pathway, predictor, estimate, std_error, t AS statistic,
         {t_tail('t', '(n - 3)')} AS p_value, n_obs, n_id, n_obs > n_id AS "used_RE"
  FROM terms JOIN ids USING (cell_major, sex)
)"""


def _bh(source: str, p: str, by: list[str], out: str = "FDR") -> str:
    """Subquery: rows of `source` with the adjusted p, by its definition."""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"""(
  SELECT * EXCLUDE (__raw), CASE WHEN {p} IS NOT NULL THEN least(1.0, min(__raw) OVER (
           {part}ORDER BY {p} NULLS LAST RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS "{out}"
  FROM (SELECT *, {p} * count({p}) OVER ({part}) / count({p}) OVER (
           {part}ORDER BY {p} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __raw
        FROM {source}) ranked
)"""


SCORES = f"""{ASSOC},
res AS (
  SELECT cell_major, sex, predictor, pathway, estimate AS beta, std_error AS se, p_value AS p, "FDR"
  FROM {_bh('fits', 'p_value', ['cell_major', 'sex', 'predictor'])} adjusted
),
scores AS (SELECT *, sign(beta) * -log10(greatest("FDR", 1e-300)) + 0.0 AS stat FROM res),
strength AS (
  SELECT cell_major, sex, pathway, max(abs(stat)) AS max_abs FROM scores GROUP BY ALL
)"""

REPORT = (
    "round(beta, 4) AS beta, round(se, 4) AS se, round(p, 6) AS p, round(\"FDR\", 6) AS \"FDR\", "
    "round(stat, 5) AS stat, round(max_abs, 5) AS max_abs"
)


def _label(column: str, width: int | None = None) -> str:
    clean = f"replace(regexp_replace({column}, '^(REACTOME|GOBP|GO|WP)_', ''), '_', ' ')"
    if width is None:
        return clean
    return f"CASE WHEN length({clean}) > {width} THEN left({clean}, {width - 3}) || '...' ELSE {clean} END"


def _strongest(cells: str = "") -> str:
    return f"""
top AS (
  SELECT * FROM strength WHERE max_abs >= {S.top_strength} {cells}
  QUALIFY row_number() OVER (PARTITION BY cell_major, sex ORDER BY max_abs DESC, pathway) <= {S.top_n}
)"""


FOCUS = f"cell_major IN ({_list(S.focus_cells)})"
FOCUS_TOP = f"{SCORES}, {_strongest('AND ' + FOCUS)}"

INTERACTION = f"""{BULK},
long AS (
  SELECT b.cell_major, b.sex, r.pathway, p.predictor, r.y, p.x, b.pct_counts_mt AS z
  FROM bulk b, LATERAL (VALUES {_pairs(SCORE_COLUMNS)}) r(pathway, y),
       LATERAL (VALUES {_pairs(PHENOS)}) p(predictor, x)
  WHERE {FOCUS} AND r.y IS NOT NULL AND p.x IS NOT NULL
),
scaled AS (
  SELECT *, stddev_samp(x) OVER (PARTITION BY cell_major, pathway, predictor) AS sd_x FROM long
),
by_sex AS (
  SELECT cell_major, pathway, predictor, sex, any_value(sd_x) AS sd_x, count(*) AS n,
         avg(x) AS mx, avg(y) AS my, avg(z) AS mz, regr_slope(z, x) AS zx, regr_slope(y, x) AS yx,
         regr_sxx(y, x) AS sxx
  FROM scaled WHERE z IS NOT NULL GROUP BY ALL
),
resid AS (
  SELECT s.*, l.z - mz - zx * (l.x - mx) AS rz, l.y - my - yx * (l.x - mx) AS ry
  FROM long l JOIN by_sex s USING (cell_major, pathway, predictor, sex) WHERE l.z IS NOT NULL
),
shared AS (
  SELECT cell_major, pathway, predictor, sum(rz * ry) / sum(rz * rz) AS c, sum(rz * rz) AS szz, count(*) AS n
  FROM resid GROUP BY ALL
),
rss AS (
  SELECT r.cell_major, r.pathway, r.predictor, sum((ry - c * rz) ** 2) AS rss
  FROM resid r JOIN shared s USING (cell_major, pathway, predictor) GROUP BY ALL
),
terms AS (
  SELECT s.cell_major, s.pathway, s.predictor, s.n,
         ((m.yx - c * m.zx) - (f.yx - c * f.zx)) * f.sd_x AS estimate,
         sqrt(rss / (s.n - 5) * (1 / f.sxx + 1 / m.sxx + (m.zx - f.zx) ** 2 / szz)) * f.sd_x AS std_error
  FROM shared s JOIN rss USING (cell_major, pathway, predictor)
  JOIN by_sex f ON f.cell_major = s.cell_major AND f.pathway = s.pathway AND f.predictor = s.predictor AND f.sex = 'female'
  JOIN by_sex m ON m.cell_major = s.cell_major AND m.pathway = s.pathway AND m.predictor = s.predictor AND m.sex = 'male'
),
with_t AS (SELECT *, estimate / std_error AS t FROM terms),
inter AS (
  SELECT cell_major, pathway, predictor, estimate, std_error, {t_tail('t', '(n - 5)')} AS p_value FROM with_t
),
inter_scores AS (
  SELECT *, sign(estimate) * -log10(greatest("FDR", 1e-300)) + 0.0 AS stat
  FROM {_bh('inter', 'p_value', [])} adjusted
),
inter_strength AS (
  SELECT cell_major, pathway, max(abs(stat)) AS max_abs FROM inter_scores WHERE stat IS NOT NULL GROUP BY ALL
),
inter_raw AS (
  SELECT * FROM inter_strength
  QUALIFY row_number() OVER (PARTITION BY cell_major ORDER BY max_abs DESC, pathway) <= {S.top_n}
),
inter_best AS (
  SELECT * FROM inter_raw WHERE max_abs >= {S.interaction_threshold}
     OR (SELECT count(*) FROM inter_raw WHERE max_abs >= {S.interaction_threshold}) = 0
),
inter_top AS (
  SELECT s.*, t.max_abs, {_label('s.pathway', 55)} AS pathway_label
  FROM inter_scores s JOIN inter_best t USING (cell_major, pathway)
)"""

INTER_REPORT = (
    "cell_major, pathway, predictor, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error, "
    "round(p_value, 6) AS p_value"
)


def _leading(distinct_items: bool) -> str:
    rows = "SELECT s.cell_major, s.sex, s.pathway, s.predictor, t.max_abs FROM scores s JOIN top t USING (cell_major, sex, pathway)"
    if distinct_items:
        rows = "SELECT DISTINCT cell_major, sex, pathway, NULL AS predictor, max_abs FROM top"
    own_effects = EFFECTS.strip()
    return f"""{FOCUS_TOP}, {own_effects},
picked AS (
  SELECT cell_major, sex, pathway FROM ({rows}) r
  QUALIFY row_number() OVER (PARTITION BY cell_major, sex ORDER BY max_abs DESC, pathway, predictor) <= {S.drivers_k}
),
linked AS (
  SELECT k.cell_major, k.sex, k.pathway, e.gene,
         CASE WHEN sign(s.stat) = sign(e."logFC") THEN 1.0 WHEN e."logFC" IS NOT NULL AND s.stat IS NOT NULL THEN 0.0 END AS same
  FROM picked k LEFT JOIN scores s USING (cell_major, sex, pathway)
  LEFT JOIN in_set e ON e.cell_major = k.cell_major AND e.sex = k.sex AND e.path_short = s.predictor
),
agreement AS (
  SELECT cell_major, sex, pathway, gene, avg(same) AS agree, count(*) AS n FROM linked
  GROUP BY cell_major, sex, pathway, gene HAVING count(*) >= {S.drivers_min_n}
),
lead AS (
  SELECT * FROM agreement
  QUALIFY row_number() OVER (PARTITION BY cell_major, sex, pathway ORDER BY agree DESC NULLS LAST, gene NULLS LAST) <= {S.drivers_n}
)"""


LEAD = _leading(True)
LEAD_COLUMNS = "cell_major, sex, pathway, gene, round(agree, 6) AS agree, n"


def _order(expr: str, panel: str, label: str) -> str:
    """Place of a label in its panel by ascending mean, as a window over groups."""
    return f"SELECT {panel}{label} AS lab, row_number() OVER ({('PARTITION BY ' + panel.rstrip(', ')) if panel else ''} ORDER BY avg({expr}), {label}) AS y_ord FROM rows GROUP BY {panel}{label}"


ORACLES: dict[str, str] = {
    "stacked_sources": f"""WITH {EFFECTS}
SELECT CASE WHEN sex = 'Female' THEN 'female_contrast' ELSE 'male_contrast' END AS idx,
       CASE WHEN sex = 'Female' THEN 'female_contrast' ELSE 'male_contrast' END AS list_name,
       CASE WHEN sex = 'Female' THEN sex END AS sex, count(*) AS n FROM effects_v GROUP BY ALL""",
    "label_counts": f"""WITH {EFFECTS}
SELECT celltype, cell_clean, cell_major, count(*) AS n FROM effects_c GROUP BY ALL
ORDER BY n DESC, celltype, cell_clean, cell_major LIMIT 20""",
    "cell_counts": f"WITH {EFFECTS} SELECT cell_major, count(*) AS n FROM effects_c GROUP BY ALL",
    "gene_set": f"WITH {EFFECTS} SELECT symbol FROM combined INTERSECT SELECT gene FROM effects_v",
    "gene_set_algebra": f"WITH {EFFECTS} SELECT symbol FROM combined INTERSECT SELECT gene FROM effects_v",
    "set_members_by_cell": f"""WITH {EFFECTS}
SELECT cell_major, CASE sex WHEN 'female' THEN 'Female' ELSE 'Male' END AS sex, count(*) AS n
FROM in_set GROUP BY ALL""",
    "gene_set_sizes": f"""WITH {EFFECTS}
SELECT (SELECT count(*) FROM annotated) AS n_annotated, (SELECT count(*) FROM prefixed) AS n_prefix,
       (SELECT count(*) FROM combined) AS n_combined,
       (SELECT count(DISTINCT gene) FROM in_set) AS n_observed""",
    "term_closure": """WITH RECURSIVE
edges AS (
  SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation
  UNION SELECT 'N' || c_nationkey || '/' || c_mktsegment, 'N' || c_nationkey FROM customer
),
tree AS (
  SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS term FROM region
  UNION SELECT t.root, e.child FROM tree t JOIN edges e ON e.parent = t.term
)
SELECT DISTINCT t.root, c_name AS symbol
FROM tree t JOIN customer ON t.term = 'N' || c_nationkey || '/' || c_mktsegment""",
    "sig_rows": f'WITH {EFFECTS} SELECT gene, cell_major, path_short, sex, "logFC", adj_p FROM sig',
    "sig_by_cell": f"WITH {EFFECTS} SELECT cell_major, count(DISTINCT gene) AS n_sig FROM sig GROUP BY ALL",
    "sig_by_cell_path": f"""WITH {CELL_PATH} SELECT cell_major, path_short, n_sig,
CAST(list_position([{LEVELS}], cell_major) AS BIGINT) AS cell_ord FROM grid""",
    "sig_boxstats": f"""WITH {CELL_PATH},
q AS (
  SELECT cell_major, quantile_cont(n_sig, 0.25) AS q1, quantile_cont(n_sig, 0.5) AS median,
         quantile_cont(n_sig, 0.75) AS q3 FROM grid GROUP BY ALL
)
SELECT g.cell_major, CAST(min(n_sig) FILTER (n_sig >= q1 - 1.5 * (q3 - q1)) AS DOUBLE) AS lower,
       any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       CAST(max(n_sig) FILTER (n_sig <= q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS upper, count(*) AS n
FROM grid g JOIN q USING (cell_major) GROUP BY g.cell_major""",
    "sig_by_cell_sex": f"""WITH {EFFECTS}, {LEVEL_TABLE},
counted AS (
  SELECT CASE WHEN grouping(path_short) = 1 THEN '(all)' ELSE path_short END AS path_short,
         cell_major, sex, count(DISTINCT gene) AS n_sig
  FROM sig GROUP BY GROUPING SETS ((path_short, cell_major, sex), (cell_major, sex))
),
cells AS (
  SELECT p.path_short, l.cell_major FROM (SELECT DISTINCT path_short FROM counted) p CROSS JOIN levels l
  UNION SELECT path_short, NULL FROM counted WHERE cell_major IS NULL
),
sexes AS (SELECT DISTINCT path_short, sex FROM counted)
SELECT c.path_short, c.cell_major, s.sex, coalesce(n.n_sig, 0) AS n_sig
FROM cells c JOIN sexes s USING (path_short) LEFT JOIN counted n
  ON n.path_short = c.path_short AND n.sex = s.sex AND n.cell_major IS NOT DISTINCT FROM c.cell_major""",
    "sig_heatmap": f"""WITH {CELL_PATH},
r AS (SELECT cell_major, row_number() OVER (ORDER BY sum(n_sig) DESC, cell_major) AS row_ord FROM grid GROUP BY cell_major),
c AS (SELECT path_short, row_number() OVER (ORDER BY sum(n_sig) DESC, path_short) AS col_ord FROM grid GROUP BY path_short)
SELECT cell_major, path_short, n_sig, round(med_lfc, 6) AS med_lfc,
       round({_clamp('med_lfc', S.bubble_cap)}, 6) AS med_lfc_cap, row_ord, col_ord
FROM grid JOIN r USING (cell_major) JOIN c USING (path_short)""",
    "sig_heatmap_sex": f"""WITH {EFFECTS}, {LEVEL_TABLE},
counted AS (
  SELECT cell_major, path_short, sex, count(DISTINCT gene) AS n_sig, median("logFC") AS med_lfc
  FROM sig WHERE cell_major IS NOT NULL GROUP BY ALL
)
SELECT l.cell_major, p.path_short, x.sex, coalesce(c.n_sig, 0) AS n_sig, round(c.med_lfc, 6) AS med_lfc,
       round({_clamp('c.med_lfc', S.bubble_cap)}, 6) AS med_lfc_cap
FROM levels l CROSS JOIN (SELECT DISTINCT path_short FROM sig) p CROSS JOIN (SELECT DISTINCT sex FROM sig) x
LEFT JOIN counted c ON c.cell_major = l.cell_major AND c.path_short = p.path_short AND c.sex = x.sex""",
    "direction_ratio": f"""WITH {EFFECTS},
d AS (
  SELECT cell_major, path_short, count(DISTINCT CASE WHEN "logFC" > 0 THEN gene END) AS up,
         count(DISTINCT CASE WHEN "logFC" <= 0 THEN gene END) AS down FROM sig GROUP BY ALL
)
SELECT *, round(log2((up + 0.5) / (down + 0.5)), 6) AS log2_up_down FROM d""",
    "recurrence_top": f"""WITH {RECUR},
rows AS (
  SELECT * FROM recur QUALIFY row_number() OVER (
    PARTITION BY cell_major ORDER BY n_path DESC, abs(pos - neg) DESC, gene) <= {S.recur_top}
)
SELECT *, row_number() OVER (PARTITION BY cell_major ORDER BY n_path, gene) AS y_ord FROM rows""",
    "recurrence_top_by_limit": f"""WITH {RECUR},
limits AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in S.recur_limits.items())}) t(cell_major, "topN"))
SELECT r.*, CAST(l."topN" AS INTEGER) AS "topN" FROM recur r JOIN limits l USING (cell_major)
QUALIFY row_number() OVER (PARTITION BY cell_major ORDER BY n_path DESC, abs(pos - neg) DESC, gene) <= l."topN\"""",
    "sex_exclusive_fisher": f"""WITH {EFFECTS},
hit AS (
  SELECT cell_major, gene, bool_or(sex = 'female') AS f, bool_or(sex = 'male') AS m FROM sig GROUP BY ALL
),
tallies AS (
  SELECT cell_major, count(*) FILTER (f AND m) AS both, count(*) FILTER (f AND NOT m) AS f_only,
         count(*) FILTER (m AND NOT f) AS m_only, count(*) FILTER (NOT m AND NOT f) AS none
  FROM hit GROUP BY ALL
), {_fisher('tallies', '"both"', 'm_only', 'f_only', '"none"')}
SELECT cell_major, "both", f_only, m_only, "none", round(p, 6) AS p_fisher,
       round(ln((f_only + 0.5) / (m_only + 0.5)), 6) AS "logOR" FROM tested""",
    "sex_enrichment": f"""WITH {EFFECTS},
totals AS (SELECT cell_major, sex, count(DISTINCT gene) AS n_total FROM in_set GROUP BY ALL),
hits AS (SELECT cell_major, sex, count(DISTINCT gene) AS n_sig FROM sig GROUP BY ALL),
wide AS (
  SELECT t.cell_major,
         CAST(coalesce(sum(n_total) FILTER (t.sex = 'female'), 0) AS BIGINT) AS n_total_female,
         CAST(coalesce(sum(n_total) FILTER (t.sex = 'male'), 0) AS BIGINT) AS n_total_male,
         CAST(coalesce(sum(n_sig) FILTER (t.sex = 'female'), 0) AS BIGINT) AS a,
         CAST(coalesce(sum(n_sig) FILTER (t.sex = 'male'), 0) AS BIGINT) AS c
  FROM totals t LEFT JOIN hits h ON h.cell_major = t.cell_major AND h.sex = t.sex GROUP BY t.cell_major
),
tab AS (SELECT *, greatest(n_total_female - a, 0) AS b, greatest(n_total_male - c, 0) AS d FROM wide),
{_fisher('tab', 'a', 'b', 'c', 'd')}
SELECT cell_major, n_total_female, n_total_male, a, b, c, d, round(p, 6) AS pval,
       round(ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))), 6) AS "logOR",
       round(-log10(p) + 0.0, 6) AS nlog10p FROM tested""",
    "bh_by_group": f"""WITH {EFFECTS}
SELECT gene, cell_major, path_short, sex, "logFC", adj_p, round("FDR", 9) AS "FDR"
FROM {_bh('in_set', 'adj_p', ['cell_major', 'path_short'])} adjusted""",
    "bh_global": f"""WITH {EFFECTS}
SELECT gene, cell_major, path_short, "logFC", adj_p, round("FDR", 9) AS "FDR"
FROM {_bh('effects_c', 'adj_p', [])} adjusted""",
    "effect_matrix": f"""WITH {MATRIX}
SELECT gene, col_key, round(v, 6) AS "logFC", split_part(col_key, '|', 1) AS cell_type,
       split_part(col_key, '|', 2) AS sex FROM mat""",
    "effect_matrix_wide": f"WITH {MATRIX} SELECT gene, "
    + ", ".join(
        f"round(max(v) FILTER (col_key = '{c}|{s}'), 6) AS \"{c}_{s}\""
        for c in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY_A", "MACHINERY_N", "MACHINERY_R"]
        for s in S.sex_levels
    )
    + " FROM mat GROUP BY gene",
    "matrix_names": f"""WITH {MATRIX}
SELECT count(*) FILTER (gene IS NULL) AS n_null, count(*) FILTER (gene = 'NA') AS n_na_text FROM mat""",
    "row_distance": _distance(MATRIX, "gene", "col_key"),
    "column_distance": _distance(MATRIX, "col_key", "gene"),
    "vector_row_distance": _distance(VECTORS, "item", "dim"),
    "vector_column_distance": _distance(VECTORS, "dim", "item"),
    "obs_profile": f"WITH {OBS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count("{c}") AS n, count(*) FILTER ("{c}" IS NULL) AS n_missing,
 round(CAST(min("{c}") AS DOUBLE), 6) AS min, round(avg("{c}"), 4) AS mean, round(CAST(max("{c}") AS DOUBLE), 6) AS max,
 round(CAST(quantile_cont("{c}", 0.25) AS DOUBLE), 6) AS q1, round(CAST(quantile_cont("{c}", 0.5) AS DOUBLE), 6) AS median,
 round(CAST(quantile_cont("{c}", 0.75) AS DOUBLE), 6) AS q3 FROM obs_v"""
        for c in _BULK_COLUMNS
    ),
    "pseudobulk": f"""WITH {BULK} SELECT projid, cell_major, sex,
{', '.join(f'round("{c}", 8) AS "{c}"' for c in _BULK_COLUMNS)} FROM pb""",
    "donor_pheno": f"WITH {BULK} SELECT projid, {', '.join(f'round({c}, 6) AS {c}' for c in PHENOS)} FROM pheno",
    "donor_pheno_first": f"WITH {BULK} SELECT projid, {', '.join(f'round({c}, 6) AS {c}' for c in PHENOS)} FROM pheno",
    "donor_check": f"""WITH {BULK}, k AS (SELECT projid, count(*) AS n FROM pheno GROUP BY ALL)
SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS n_repeated FROM k""",
    "missing_phenotypes": f"WITH {OBS} SELECT 'absent' AS missing, count(*) AS n_rows FROM obs_v",
    "bulk_pheno": f"""WITH {BULK} SELECT projid, cell_major, sex,
{', '.join(f'round("{c}", {8 if c in _BULK_COLUMNS else 6}) AS "{c}"' for c in _BULK_COLUMNS + PHENOS)} FROM bulk""",
    "standardised": f"""WITH {OBS}, d AS (SELECT DISTINCT projid, cell_major, sex, acctbal FROM obs_v)
SELECT *, round((acctbal - avg(acctbal) OVER w) / stddev_samp(acctbal) OVER w, 6) AS scaled
FROM d WINDOW w AS (PARTITION BY cell_major, sex)""",
    "assoc": f"""WITH {ASSOC} SELECT cell_major, sex, pathway, predictor, round(estimate, 4) AS estimate,
round(std_error, 4) AS std_error, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value,
n_obs, n_id, "used_RE" FROM fits""",
    "assoc_fdr": f"""WITH {SCORES} SELECT cell_major, sex, predictor, pathway, round(beta, 4) AS beta,
round(se, 4) AS se, round(p, 6) AS p, round("FDR", 6) AS "FDR" FROM res""",
    "signed_score": f"""WITH {SCORES} SELECT cell_major, sex, predictor, pathway, round(stat, 5) AS stat,
round(stat, 5) AS stat_grouped FROM scores""",
    "pathway_keyword": f"""WITH {SCORES} SELECT cell_major, sex, predictor, pathway, round(stat, 5) AS stat
FROM scores WHERE regexp_matches(pathway, '{S.keywords}', 'i')""",
    "top_pathways": f"""WITH {SCORES}, {_strongest()},
rows AS (
  SELECT s.*, t.max_abs, {_label('s.pathway', 60)} AS pathway_label, s.cell_major || '.' || s.sex AS panel
  FROM scores s JOIN top t USING (cell_major, sex, pathway)
),
places AS ({_order('max_abs', 'panel, ', 'pathway_label')})
SELECT cell_major, sex, predictor, pathway, {REPORT}, pathway_label, r.panel, y_ord
FROM rows r JOIN places p ON p.panel = r.panel AND p.lab = r.pathway_label""",
    "focus_pathways": f"""WITH {FOCUS_TOP},
rows AS (
  SELECT s.*, t.max_abs, {_label('s.pathway')} AS pathway_label
  FROM scores s JOIN top t USING (cell_major, sex, pathway)
),
places AS ({_order('max_abs', '', 'pathway_label')})
SELECT cell_major, sex, predictor, pathway, {REPORT}, pathway_label, y_ord
FROM rows r JOIN places p ON p.lab = r.pathway_label""",
    "strength_crosstab": f"""WITH {SCORES}
SELECT cell_major, count(*) FILTER (max_abs >= {S.top_strength}) AS n_true,
       count(*) FILTER (max_abs < {S.top_strength}) AS n_false
FROM strength WHERE max_abs IS NOT NULL GROUP BY ALL""",
    "sex_contrast": f"""WITH {SCORES},
side AS (
  SELECT cell_major, pathway, sex, avg(stat) AS m, stddev_samp(stat) AS sd, count(stat) AS n
  FROM scores WHERE {FOCUS} GROUP BY ALL
),
both_sides AS (
  SELECT cell_major, pathway, max(m) FILTER (sex = 'female') AS m_female, max(sd) FILTER (sex = 'female') AS sd_female,
         max(n) FILTER (sex = 'female') AS n_female, max(m) FILTER (sex = 'male') AS m_male,
         max(sd) FILTER (sex = 'male') AS sd_male, max(n) FILTER (sex = 'male') AS n_male
  FROM side GROUP BY ALL
),
delta AS (
  SELECT *, m_female - m_male AS delta,
         sqrt(sd_female ** 2 / greatest(n_female, 1) + sd_male ** 2 / greatest(n_male, 1)) AS se
  FROM both_sides
),
rows AS (
  SELECT *, se * 1.96 AS ci, {_label('pathway', 60)} AS label FROM delta
  QUALIFY row_number() OVER (PARTITION BY cell_major ORDER BY abs(delta) DESC NULLS LAST, pathway) <= {S.contrast_n}
),
places AS ({_order('delta', 'cell_major, ', 'label')})
SELECT r.cell_major, pathway, round(m_female, 5) AS m_female, round(sd_female, 5) AS sd_female, n_female,
       round(m_male, 5) AS m_male, round(sd_male, 5) AS sd_male, n_male, round(delta, 5) AS delta,
       round(se, 5) AS se, round(ci, 5) AS ci, label, y_ord
FROM rows r JOIN places p ON p.cell_major = r.cell_major AND p.lab = r.label""",
    "interaction": f"WITH {INTERACTION} SELECT {INTER_REPORT} FROM inter",
    "interaction_fdr": f"""WITH {INTERACTION} SELECT {INTER_REPORT}, round("FDR", 6) AS "FDR",
round(stat, 5) AS stat FROM inter_scores""",
    "interaction_top": f"""WITH {INTERACTION},
rows AS (SELECT * FROM inter_top),
places AS ({_order('max_abs', 'cell_major, ', 'pathway_label')}),
preds AS (SELECT predictor, row_number() OVER (ORDER BY max(abs(stat)) DESC, predictor) AS pred_ord FROM rows GROUP BY predictor)
SELECT {INTER_REPORT.replace('cell_major', 'r.cell_major', 1)}, round("FDR", 6) AS "FDR", round(stat, 5) AS stat,
       round(max_abs, 5) AS max_abs, pathway_label, y_ord, pred_ord
FROM rows r JOIN places p ON p.cell_major = r.cell_major AND p.lab = r.pathway_label JOIN preds USING (predictor)""",
    "interaction_top_rows": f"WITH {INTERACTION} SELECT count(*) AS n_rows FROM inter_top",
    "drivers": f"WITH {LEAD} SELECT {LEAD_COLUMNS} FROM lead",
    "drivers_as_written": f"WITH {_leading(False)} SELECT {LEAD_COLUMNS} FROM lead",
    "drivers_report": f"""WITH {LEAD} SELECT {LEAD_COLUMNS} FROM lead
ORDER BY cell_major, sex, pathway, lead.agree DESC NULLS LAST, gene NULLS LAST LIMIT 100""",
    "drivers_focus": f"""WITH {LEAD}, named AS (SELECT *, {_label('pathway', 50)} AS path_label FROM lead)
SELECT {LEAD_COLUMNS}, path_label FROM named WHERE regexp_matches(path_label, '{S.driver_keywords}', 'i')
QUALIFY row_number() OVER (PARTITION BY cell_major, sex, path_label
  ORDER BY named.agree DESC NULLS LAST, pathway, gene NULLS LAST) <= {S.drivers_label_n}""",
    "drivers_for": f"""WITH {LEAD}, named AS (SELECT *, {_label('pathway')} AS path_clean FROM lead)
SELECT {LEAD_COLUMNS}, path_clean FROM named
WHERE cell_major = 'BUILDING' AND regexp_matches(path_clean, 'order share|price', 'i')
QUALIFY row_number() OVER (PARTITION BY sex ORDER BY named.agree DESC NULLS LAST, pathway, gene NULLS LAST) <= {S.drivers_n}""",
    "drivers_for_none": f"""WITH {LEAD}, named AS (SELECT *, {_label('pathway')} AS path_clean FROM lead)
SELECT {LEAD_COLUMNS}, path_clean FROM named
WHERE cell_major = 'AUTOMOBILE' AND regexp_matches(path_clean, '^REACTOME_PRICE$', 'i')""",
    "driver_examples": f"""WITH {LEAD} SELECT DISTINCT {_label('pathway')} AS path_clean FROM lead
WHERE cell_major = 'AUTOMOBILE' ORDER BY path_clean LIMIT 10""",
    "contrast_files": """SELECT 'customer' AS list_name, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS customers, CAST(NULL AS BIGINT) AS suppliers FROM customer
UNION ALL SELECT 'supplier', count(*), NULL, CAST(sum(s_suppkey) AS BIGINT) FROM supplier""",
    "source_fallback": """SELECT 'view' AS source, count(*) AS n FROM nation UNION ALL SELECT 'path', count(*) FROM part
UNION ALL SELECT 'derived', count(DISTINCT c_nationkey) FROM customer""",
}
ORACLES["interaction_top_fallback"] = ORACLES["interaction_top"].replace(
    f"max_abs >= {S.interaction_threshold}", "max_abs >= 1e9"
)


def _revised(sql: str) -> str:
    return sql.replace(
        "c_acctbal AS acctbal", "c_acctbal + CASE WHEN l_linenumber = 7 THEN 1.0 ELSE 0.0 END AS acctbal, l_orderkey * 10 + l_linenumber AS row_order"
    )


ORACLES["donor_check_revised"] = _revised(ORACLES["donor_check"])
ORACLES["bulk_pheno_revised"] = _revised(ORACLES["bulk_pheno"])
ORACLES["donor_pheno_first_revised"] = f"""WITH {_revised(OBS)}
SELECT projid, {', '.join(f'round({c}, 6) AS {c}' for c in PHENOS)} FROM obs_v
QUALIFY row_number() OVER (PARTITION BY projid ORDER BY row_order) = 1"""

SITED = f"""{BULK},
sited AS (SELECT b.*, c_nationkey AS site FROM bulk b LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = projid)"""

# every panel of min_n rows has a site twice: there are fewer nations than that
ORACLES["assoc_mixed"] = f"""WITH {SITED},
panels AS (
  SELECT cell_major, sex, count(*) AS n_obs, count(DISTINCT site) AS n_id FROM sited
  WHERE cell_major IN ({LEVELS}) GROUP BY ALL HAVING count(*) >= {S.min_n}
),
long AS (
  SELECT b.cell_major, b.sex, b.site, r.pathway, p.predictor, r.y, p.x, b.pct_counts_mt AS z
  FROM sited b JOIN panels USING (cell_major, sex), LATERAL (VALUES {_pairs(SCORE_COLUMNS)}) r(pathway, y),
       LATERAL (VALUES {_pairs(PHENOS)}) p(predictor, x)
),
centred AS (
  SELECT *, (x - avg(x) OVER g) / stddev_samp(x) OVER g AS xs, (z - avg(z) OVER g) / stddev_samp(z) OVER g AS zs,
         y - avg(y) OVER g AS ys
  FROM long WINDOW g AS (PARTITION BY cell_major, sex, pathway, predictor)
),
cases AS (SELECT * FROM centred WHERE xs IS NOT NULL AND zs IS NOT NULL AND ys IS NOT NULL),
{random_intercept_sql("cases", ["cell_major", "sex", "pathway", "predictor"], "site", ["1.0", "zs", "xs"], "ys", "fitted")}
SELECT cell_major, sex, pathway, predictor, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error,
       round(estimate / std_error, 4) AS statistic, CAST(NULL AS DOUBLE) AS p_value, n_obs, n_id, n_obs > n_id AS "used_RE"
FROM fitted JOIN panels USING (cell_major, sex)"""

ORACLES["interaction_mixed"] = f"""WITH {SITED},
long AS (
  SELECT b.cell_major, b.sex, b.site, r.pathway, p.predictor, r.y, p.x, b.pct_counts_mt AS z
  FROM sited b, LATERAL (VALUES {_pairs(SCORE_COLUMNS)}) r(pathway, y), LATERAL (VALUES {_pairs(PHENOS)}) p(predictor, x)
  WHERE {FOCUS} AND r.y IS NOT NULL AND p.x IS NOT NULL
),
centred AS (
  SELECT *, CASE WHEN sex = 'male' THEN 1.0 ELSE 0.0 END AS m, (x - avg(x) OVER g) / stddev_samp(x) OVER g AS xs,
         (z - avg(z) OVER g) / stddev_samp(z) OVER g AS zs, y - avg(y) OVER g AS ys
  FROM long WINDOW g AS (PARTITION BY cell_major, pathway, predictor)
),
cases AS (SELECT * FROM centred WHERE xs IS NOT NULL AND zs IS NOT NULL),
{random_intercept_sql("cases", ["cell_major", "pathway", "predictor"], "site", ["1.0", "zs", "m", "xs", "m * xs"], "ys", "fitted")}
SELECT cell_major, pathway, predictor, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error,
       round({normal_tail("estimate / std_error")}, 6) AS p_value
FROM fitted"""

# the file has the orders by their key
ORACLES["donor_first_in_file"] = """
SELECT CAST(o_custkey AS VARCHAR) AS projid, min(o_orderkey) AS o_orderkey, round(arg_min(o_totalprice, o_orderkey), 2) AS o_totalprice,
       arg_min(o_orderpriority, o_orderkey) AS o_orderpriority
FROM orders GROUP BY o_custkey"""
