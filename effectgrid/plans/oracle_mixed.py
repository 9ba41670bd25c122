"""SQL for the random-intercept queries: a search over the variance ratio on finer and finer grids."""

from __future__ import annotations

from collections.abc import Sequence


def normal_tail(z: str) -> str:
    """Two-sided normal tail by the series of the error function, whose terms are all positive."""
    size = f"least(abs({z}), 12.0)"
    series = (
        "list_reduce(list_prepend(CAST(1 AS DOUBLE), list_transform(range(300, 0, -1), lambda i: CAST(i AS DOUBLE))), "
        f"lambda acc, k: 1 + {size} * {size} / (2 * k + 1) * acc)"
    )
    return f"(1 - 2 / sqrt(pi()) * exp(-{size} * {size} / 2) * {size} / sqrt(2.0) * {series})"


def random_intercept_sql(rows: str, keys: Sequence[str], subject: str, design: Sequence[str], response: str, out: str) -> str:
    """CTEs up to `out` (keys, estimate, std_error) for the last column of `design`.

    rows is a relation without nulls in the design and the response. Every
    candidate variance ratio is tried with the sums of all subjects; regressors are
    eliminated one after the other, the response is last.
    """
    by = ", ".join(keys)
    columns = [*design, response]
    p = len(design)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    own = lambda name: f"{out}_{name}"
    ctes = [
        f"{own('subjects')} AS MATERIALIZED (SELECT {by}, {subject}, CAST(count(*) AS DOUBLE) AS n, "
        + ", ".join(f"sum({c}) AS s{i}" for i, c in enumerate(columns))
        + ", "
        + ", ".join(f"sum(({columns[i]}) * ({columns[j]})) AS c{i}_{j}" for i, j in pairs)
        + f" FROM {rows} GROUP BY {by}, {subject})"
    ]

    def tried(candidates: str) -> str:
        """(keys, g, th, total, deviance, b, spread, rss) of each candidate."""
        sql, _ = eliminated(candidates, p - 1)
        last = f"a{p}_{p} - a{p - 1}_{p} * a{p - 1}_{p} / a{p - 1}_{p - 1}"
        return (
            f"SELECT *, logs + total * ln(rss / total) AS deviance FROM (SELECT {by}, g, th, total, logs, "
            f"a{p - 1}_{p} / a{p - 1}_{p - 1} AS b, a{p - 1}_{p - 1} AS spread, {last} AS rss FROM ({sql}))"
        )

    def eliminated(candidates: str, steps: int) -> tuple[str, list[str]]:
        sums = ", ".join(f"sum(c{i}_{j} - th / (1 + n * th) * s{i} * s{j}) AS a{i}_{j}" for i, j in pairs)
        sql = (
            f"SELECT {by}, g, th, sum(n) AS total, sum(ln(1 + n * th)) AS logs, {sums} "
            f"FROM {own('subjects')} JOIN {candidates} USING ({by}) GROUP BY {by}, g, th"
        )
        pivots: list[str] = []
        for k in range(steps):
            pivots += [f"u{k}_{j}" for j in range(k, p + 1)]
            rest = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i, j in pairs if i > k]
            kept = [u for u in pivots if not u.startswith(f"u{k}_")] + [f"a{k}_{j} AS u{k}_{j}" for j in range(k, p + 1)]
            sql = f"SELECT {by}, g, th, total, logs, {', '.join([*rest, *kept])} FROM ({sql})"
        return sql, pivots

    def slopes(candidates: str) -> str:
        """(keys, g, slope): the slope of the deviance, from the residual sums of the subjects."""
        sql, _ = eliminated(candidates, p)
        for k in range(p - 1, -1, -1):
            behind = "".join(f" - u{k}_{j} * b{j}" for j in range(k + 1, p))
            sql = f"SELECT *, (u{k}_{p}{behind}) / u{k}_{k} AS b{k} FROM ({sql})"
        residual = f"s{p}" + "".join(f" - s{k} * b{k}" for k in range(p))
        return (
            f"SELECT {by}, g, sum(n / (1 + n * th)) - any_value(total) * sum((({residual}) / (1 + n * th)) ** 2) / any_value(a{p}_{p}) AS slope "
            f"FROM {own('subjects')} JOIN ({sql}) USING ({by}) GROUP BY {by}, g"
        )

    most = f"(SELECT {by}, max(n) AS most FROM {own('subjects')} GROUP BY {by})"
    grid = f"SELECT {by}, g, exp(g) AS th FROM (SELECT {by}, -12 - ln(most) + unnest(range(0, 97 + 4 * 12)) * 0.25 AS g FROM {most})"
    ctes.append(f"{own('grid')} AS MATERIALIZED ({grid})")
    ctes.append(
        f"{own('best0')} AS MATERIALIZED (SELECT {by}, arg_min(g, deviance) - 0.25 AS g FROM ({tried(own('grid'))}) GROUP BY {by})"
    )
    step = 0.5
    for k in range(1, 11):
        # the last of twelve points at which the deviance still falls begins the next, shorter range
        step /= 12
        ctes.append(
            f"{own(f'at{k}')} AS MATERIALIZED (SELECT {by}, g, exp(g) AS th FROM "
            f"(SELECT {by}, g + unnest(range(0, 12)) * {step!r} AS g FROM {own(f'best{k - 1}')}))"
        )
        ctes.append(
            f"{own(f'best{k}')} AS MATERIALIZED (SELECT {by}, coalesce(max(g) FILTER (slope < 0), min(g)) AS g "
            f"FROM ({slopes(own(f'at{k}'))}) GROUP BY {by})"
        )
    ctes.append(
        f"{own('ends')} AS MATERIALIZED (SELECT {by}, g, exp(g) AS th FROM {own('best10')} "
        f"UNION ALL SELECT {by}, g, 0 AS th FROM {own('best10')})"
    )
    ctes.append(
        f"{own('chosen')} AS MATERIALIZED (SELECT {by}, any_value(g) AS g, arg_min(th, (deviance, th)) AS th "
        f"FROM ({tried(own('ends'))}) GROUP BY {by})"
    )
    ctes.append(f"{out} AS (SELECT {by}, b AS estimate, sqrt(rss / total / spread) AS std_error FROM ({tried(own('chosen'))}))")
    return ",\n".join(ctes)
