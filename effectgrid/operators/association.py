"""Grouped linear models from sufficient statistics.

Responses and predictors stay columns: the moments of all models of a key come
from blocked matrix products over its rows (`gram`), read once. The coefficients
follow in closed form. Only models with a random intercept, whose sums are by
subject, unpivot their rows, and only of keys in which a subject repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectgrid.functions.scalars import finite_or_null, nan_to_null, quoted
from effectgrid.functions.special import normal_two_sided, t_two_sided
from effectgrid.operators import gram, mixed
from effectgrid.operators.joins import null_safe_join
from effectgrid.session import checkpointed

RESPONSE, PREDICTOR = "pathway", "predictor"
# fixed values: a regressor this close to collinear has no coefficient, nor has one whose
# complete cases have no more than this part of its variance
_COLLINEAR = 1e-14
_FLAT = 1e-13


def melt(
    df: DataFrame, ids: list[str], responses: list[str], predictors: list[str], covariate: str
) -> DataFrame:
    """One row per (row of df, response, predictor): ids, pathway, y, predictor, x, z."""
    def number(c: str) -> Column:
        return nan_to_null(quoted(c).cast("double"))

    def stacked(columns: list[str], name: str, value: str) -> Column:
        pairs = [F.struct(F.lit(c).alias(name), number(c).alias(value)) for c in columns]
        return F.inline(F.array(*pairs))

    by_response = df.select(
        *ids,
        number(covariate).alias("z"),
        *[quoted(c) for c in predictors if c not in ids],
        stacked(responses, RESPONSE, "y"),
    )
    return by_response.select(*ids, "z", RESPONSE, "y", stacked(predictors, PREDICTOR, "x"))


def standardise(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """(value - mean) / sd over the non-null rows of the group; null if sd is 0.

    Mean and sd come from a combining aggregate joined back, not from a window,
    so a large group is not sorted in one task.
    """
    stats = df.groupBy(*by).agg(
        F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd")
    )
    return (
        null_safe_join(df, stats, by, "left")
        .withColumn(out, F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd")))
        .drop("__mean", "__sd")
    )


def group_sizes(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Rows, distinct subjects, and whether subjects repeat, per group."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.countDistinct(ident).alias("n_id")
    ).withColumn("used_RE", F.col("n_obs") > F.col("n_id"))


def _sd(products: Column, n: Column) -> Column:
    return F.when(n > 1, F.sqrt(products / (n - 1)))


def _sample(n: Column, **products: Column) -> dict[str, Column]:
    """Sample (co)variances of centred products; null below two rows."""
    return {name: F.when(n > 1, c / (n - 1)) for name, c in products.items()}


def _additive(
    df: DataFrame, keys: list[str], responses: list[str], predictors: list[str], covariate: str
) -> DataFrame:
    """Per model: sd of x over its non-null rows, then y ~ x + z on complete cases."""
    found = gram.model_moments(df, keys, responses, predictors, covariate, (RESPONSE, PREDICTOR))
    n = F.col("n")
    products = {c: F.col(c) for c in ("xx", "zz", "yy", "xz", "xy", "zy")}
    return found.select(
        *keys, RESPONSE, PREDICTOR,
        _sd(F.col("x_xx"), F.col("x_n")).alias("sd_x"),
        F.when(F.col("x_n") > 0, F.col("x_mean")).alias("mean_x"),
        _sd(F.col("z_zz"), F.col("z_n")).alias("sd_z"),
        F.when(F.col("z_n") > 0, F.col("z_mean")).alias("mean_z"),
        F.when(n > 0, F.col("my")).alias("mean_y"),
        n.cast("bigint").alias("n"),
        *[c.alias(name) for name, c in _sample(n, **products).items()],
    )


def _usable(sd: str) -> Column:
    """Spread known and not zero."""
    return F.col(sd).isNotNull() & (F.col(sd) != 0)


def associate_ols(
    df: DataFrame, keys: list[str], responses: list[str], predictors: list[str],
    covariate: str, ident: str, min_n: int = 30, sizes: DataFrame | None = None,
) -> DataFrame:
    """y ~ scale(x) + scale(z) per (keys, response, predictor); the term of x.

    Scaling uses all non-null rows of the group, the fit complete cases; it
    only rescales the coefficient, so the fit runs on the raw columns. Groups
    below `min_n` rows and predictors without spread give no row. `sizes` are
    the keys' `group_sizes`, if they are known.
    """
    model = keys + [RESPONSE, PREDICTOR]
    sizes = (group_sizes(df, keys, ident) if sizes is None else sizes).filter(F.col("n_obs") >= min_n)
    fits = _additive(df, keys, responses, predictors, covariate).filter(_usable("sd_x"))
    return _with_additive_terms(null_safe_join(fits, sizes, keys)).select(
        *model, "estimate", "std_error", "statistic", "p_value", "n_obs", "n_id", "used_RE"
    )


def _with_additive_terms(fits: DataFrame) -> DataFrame:
    xx, zz, yy, xz, xy, zy = (F.col(c) for c in ("xx", "zz", "yy", "xz", "xy", "zy"))
    det = xx * zz - xz * xz
    flat = (xx <= _FLAT * F.col("sd_x") ** 2) | (zz <= _FLAT * F.col("sd_z") ** 2)
    full_rank = (det > F.lit(_COLLINEAR) * xx * zz) & (F.col("n") > 3) & ~flat
    slope, other = (zz * xy - xz * zy), (xx * zy - xz * xy)
    fits = fits.withColumn("__det", F.when(full_rank, det))
    fits = fits.withColumns(
        {"__bx": F.try_divide(slope, F.col("__det")), "__bz": F.try_divide(other, F.col("__det"))}
    )
    rss = F.greatest((F.col("n") - 1) * (yy - F.col("__bx") * xy - F.col("__bz") * zy), F.lit(0.0))
    variance = F.try_divide(rss * zz, (F.col("n") - 3) * (F.col("n") - 1) * F.col("__det"))
    usable = F.col("__det").isNotNull()
    return (
        fits.withColumn("estimate", F.col("__bx") * F.col("sd_x"))
        .withColumn("std_error", F.when(usable, F.sqrt(variance) * F.col("sd_x")))
        .withColumn("statistic", F.try_divide("estimate", "std_error"))
        .withColumn("p_value", t_two_sided("statistic", "n - 3"))
    )


def associate_mixed(
    df: DataFrame, keys: list[str], responses: list[str], predictors: list[str],
    covariate: str, ident: str, min_n: int = 30,
) -> DataFrame:
    """As `associate_ols`, with a random intercept per subject, where subjects repeat.

    As there, predictors without spread give no row, and models that cannot be
    fitted (a covariate without spread, no complete case) a row of nulls.
    """
    model = keys + [RESPONSE, PREDICTOR]
    sizes = group_sizes(df, keys, ident).filter((F.col("n_obs") >= min_n) & F.col("used_RE"))
    repeated = null_safe_join(df, sizes.select(*keys), keys, "left_semi")
    cases = melt(repeated, keys + [ident], responses, predictors, covariate)
    scales = _additive(repeated, keys, responses, predictors, covariate).filter(_usable("sd_x"))
    scaled = null_safe_join(
        cases, scales.filter(_usable("sd_z")).select(*model, "sd_x", "mean_x", "sd_z", "mean_z", "mean_y"), model
    )
    design = {
        "intercept": F.lit(1.0),
        "x": (F.col("x") - F.col("mean_x")) / F.col("sd_x"),
        "z": (F.col("z") - F.col("mean_z")) / F.col("sd_z"),
    }
    fits = mixed.random_intercept(
        scaled, model, ident, design, F.col("y") - F.col("mean_y"), term="x"
    )
    every = null_safe_join(scales.select(*model), fits, model, "left")
    return null_safe_join(every, sizes, keys).select(
        *model, "estimate", "std_error", "statistic",
        F.lit(None).cast("double").alias("p_value"), "n_obs", "n_id", "used_RE",
    )


def associate(
    df: DataFrame, keys: list[str], responses: list[str], predictors: list[str],
    covariate: str, ident: str, min_n: int = 30,
) -> DataFrame:
    """Least squares where each subject has one row, a random intercept where not.

    Whether a subject repeats is counted first (`df` is read for it): without
    one, no random intercept is planned.
    """
    args = (df, keys, responses, predictors, covariate, ident, min_n)
    sizes = checkpointed(group_sizes(df, keys, ident))
    plain = associate_ols(*args, sizes).filter(~F.col("used_RE"))
    if sizes.filter("used_RE").isEmpty():
        return plain
    return plain.unionByName(associate_mixed(*args))


def _interaction_moments(
    df: DataFrame, keys: list[str], group: str, levels: list[str], responses: list[str],
    predictors: list[str], covariate: str,
) -> DataFrame:
    """Scale of x over all rows with finite x and y, and the moments of each level."""
    found = gram.model_moments(df, [*keys, group], responses, predictors, covariate, (RESPONSE, PREDICTOR), finite_or_null)
    planes = (*gram.PAIRED, *gram.COMPLETE)
    own = {f"{c}{i}": F.max(F.when(F.col(group) == level, F.col(c))) for i, level in enumerate(levels) for c in planes}
    wide = found.groupBy(*keys, RESPONSE, PREDICTOR).agg(*[c.alias(f"__{name}") for name, c in own.items()])
    wide = wide.na.fill(0.0, [f"__{c}{i}" for i in range(len(levels)) for c in ("pair_n", "n")])

    def pooled(count: str, mean: str, products: str) -> tuple[Column, Column]:
        """Mean and sd over both levels."""
        n = [F.col(f"__{count}{i}") for i in (0, 1)]
        m = [F.coalesce(F.when(k > 0, F.col(f"__{mean}{i}")), F.lit(0.0)) for i, k in enumerate(n)]
        within = [F.when(k > 0, F.col(f"__{products}{i}")).otherwise(0.0) for i, k in enumerate(n)]
        total = n[0] + n[1]
        between = (m[0] - m[1]) ** 2 * F.try_divide(n[0] * n[1], total)
        return F.try_divide(n[0] * m[0] + n[1] * m[1], total), _sd(within[0] + within[1] + between, total)

    mean_x, sd_x = pooled("pair_n", "pair_mx", "pair_xx")
    mean_z, sd_z = pooled("n", "mz", "zz")
    mean_y, _ = pooled("pair_n", "pair_my", "pair_xx")
    named = {"mean_x": mean_x, "sd_x": sd_x, "mean_z": mean_z, "sd_z": sd_z, "mean_y": mean_y}
    for i in range(len(levels)):
        n = F.col(f"__n{i}")
        named |= {f"rows{i}": F.col(f"__pair_n{i}").cast("bigint"), f"n{i}": n.cast("bigint")}
        products = {f"{c}{i}": F.col(f"__{c}{i}") for c in ("xx", "zz", "yy", "xz", "xy", "zy")}
        # what has no spread in a level but rounding has none
        for c in ("xx", "zz"):
            sd = sd_x if c == "xx" else sd_z
            products[f"{c}{i}"] = F.when(products[f"{c}{i}"] <= _FLAT * n * sd**2, 0.0).otherwise(products[f"{c}{i}"])
        named |= _sample(n, **products)
    return wide.select(*keys, RESPONSE, PREDICTOR, *[c.alias(name) for name, c in named.items()])


def _finite(cases: DataFrame) -> DataFrame:
    return cases.withColumns({c: finite_or_null(F.col(c)) for c in ("x", "y")})


def interact_ols(
    df: DataFrame, keys: list[str], group: str, levels: list[str], responses: list[str],
    predictors: list[str], covariate: str, ident: str,
) -> DataFrame:
    """y ~ group * scale(x) + scale(z) per (keys, response, predictor).

    Returns the interaction of x with the second level. Both levels have their
    own intercept and slope and share the slope of z, so after centring within
    a level three normal equations remain. A single level gives a null row.
    """
    model = keys + [RESPONSE, PREDICTOR]
    fits = _interaction_moments(df, keys, group, levels, responses, predictors, covariate)

    def sums(name: str, i: int) -> Column:
        return (F.col(f"n{i}") - 1) * F.col(f"{name}{i}")

    both = (F.col("rows0") > 0) & (F.col("rows1") > 0) & _usable("sd_x") & _usable("sd_z")
    xx, zz, yy, xz, xy, zy = (
        [sums(name, i) for i in (0, 1)] for name in ("xx", "zz", "yy", "xz", "xy", "zy")
    )
    rest = zz[0] + zz[1] - F.try_divide(xz[0] * xz[0], xx[0]) - F.try_divide(xz[1] * xz[1], xx[1])
    enough = F.col("n0") + F.col("n1") > 5
    fits = fits.withColumn(
        "__rest", F.when(both & enough & (rest > F.lit(_COLLINEAR) * (zz[0] + zz[1])), rest)
    )
    shared = (
        zy[0] + zy[1]
        - F.try_divide(xz[0] * xy[0], xx[0])
        - F.try_divide(xz[1] * xy[1], xx[1])
    )
    fits = fits.withColumn("__c", F.try_divide(shared, F.col("__rest")))
    fits = fits.withColumns(
        {f"__b{i}": F.try_divide(xy[i] - xz[i] * F.col("__c"), xx[i]) for i in (0, 1)}
    )
    rss = F.greatest(
        yy[0] + yy[1]
        - F.col("__b0") * xy[0]
        - F.col("__b1") * xy[1]
        - F.col("__c") * (zy[0] + zy[1]),
        F.lit(0.0),
    )
    tilt = F.try_divide(xz[1], xx[1]) - F.try_divide(xz[0], xx[0])
    spread = (
        F.try_divide(F.lit(1.0), xx[0])
        + F.try_divide(F.lit(1.0), xx[1])
        + F.try_divide(tilt * tilt, F.col("__rest"))
    )
    dof = F.col("n0") + F.col("n1") - 5
    known = F.col("__b0").isNotNull() & F.col("__b1").isNotNull()
    return (
        fits.withColumn("estimate", (F.col("__b1") - F.col("__b0")) * F.col("sd_x"))
        .withColumn(
            "std_error", F.when(known, F.sqrt(F.try_divide(rss, dof) * spread) * F.col("sd_x"))
        )
        .withColumn("__t", F.try_divide("estimate", "std_error"))
        .withColumn("p_value", t_two_sided("__t", "n0 + n1 - 5"))
        .select(*model, "estimate", "std_error", "p_value")
    )


def interact_mixed(
    df: DataFrame, keys: list[str], group: str, levels: list[str], responses: list[str],
    predictors: list[str], covariate: str, ident: str,
) -> DataFrame:
    """As `interact_ols` with a random intercept, for models in which a subject repeats."""
    model = keys + [RESPONSE, PREDICTOR]
    repeats = group_sizes(df, keys, ident).filter("used_RE").select(*keys)
    own = null_safe_join(df, repeats, keys, "left_semi")
    cases = _finite(melt(own, keys + [ident, group], responses, predictors, covariate))
    cases = cases.filter(
        F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(group).isin(levels)
    )
    # the model has a repeat if some subject has two usable rows in it
    repeated = (
        cases.groupBy(*model, ident).agg(F.count("*").alias("__k"))
        .groupBy(*model).agg(F.max("__k").alias("__k")).filter(F.col("__k") > 1).select(*model)
    )
    scales = _interaction_moments(own, keys, group, levels, responses, predictors, covariate).filter(
        (F.col("rows0") > 0) & (F.col("rows1") > 0) & _usable("sd_x") & _usable("sd_z")
    )
    scales = null_safe_join(scales, repeated, model, "left_semi")
    scaled = null_safe_join(
        cases, scales.select(*model, "sd_x", "mean_x", "sd_z", "mean_z", "mean_y"), model
    )
    second = F.when(F.col(group) == levels[1], 1.0).otherwise(0.0)
    x = (F.col("x") - F.col("mean_x")) / F.col("sd_x")
    design = {
        "intercept": F.lit(1.0),
        "second": second,
        "x": x,
        "interaction": second * x,
        "z": (F.col("z") - F.col("mean_z")) / F.col("sd_z"),
    }
    fits = mixed.random_intercept(
        scaled, model, ident, design, F.col("y") - F.col("mean_y"), term="interaction"
    )
    return fits.withColumn("p_value", normal_two_sided("statistic")).select(
        *model, "estimate", "std_error", "p_value"
    )


def interact(
    df: DataFrame, keys: list[str], group: str, levels: list[str], responses: list[str],
    predictors: list[str], covariate: str, ident: str,
) -> DataFrame:
    """Interaction term per model: random intercept where a subject repeats, else least squares."""
    args = (df, keys, group, levels, responses, predictors, covariate, ident)
    model = keys + [RESPONSE, PREDICTOR]
    without = interact_ols(*args)
    if group_sizes(df, keys, ident).filter("used_RE").isEmpty():
        return without.select(*model, "estimate", "std_error", "p_value")
    with_re = interact_mixed(*args).withColumn("__re", F.lit(True))
    chosen = null_safe_join(
        without,
        with_re.withColumnsRenamed({c: f"__{c}" for c in ("estimate", "std_error", "p_value")}),
        model,
        "left",
    )
    return chosen.select(
        *model,
        *[
            F.when(F.col("__re"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
            for c in ("estimate", "std_error", "p_value")
        ],
    )
