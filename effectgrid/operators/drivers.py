"""Items whose effect signs agree with the sign of a set-level score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.functions.labels import pathway_label
from effectgrid.operators.checks import require_columns
from effectgrid.operators.filters import matches
from effectgrid.operators.topn import top_n_per_group
from effectgrid.session import checkpointed

PANEL = ["cell_major", "sex"]
# genes of a panel and predictor that one part of the join holds
PART_GENES = 250_000


def top_items(strong: DataFrame, k: int = 5, distinct_items: bool = True) -> DataFrame:
    """The k strongest pathways per panel.

    `strong` has one row per (panel, pathway, predictor) with max_abs repeated.
    With `distinct_items` false the k rows are taken as they come, so one
    pathway may fill several of them.
    """
    rows = strong.select(*PANEL, "pathway", "predictor", "max_abs")
    order = [F.desc_nulls_last("max_abs"), F.asc("pathway")]
    if distinct_items:
        rows = rows.select(*PANEL, "pathway", "max_abs").distinct()
    else:
        order.append(F.asc("predictor"))
    return top_n_per_group(rows, PANEL, order, k).select(*PANEL, "pathway")


def sign_agreement(top: DataFrame, scores: DataFrame, effects: DataFrame) -> DataFrame:
    """Share of effect rows with the sign of the score, per (panel, pathway, gene).

    Effects are first reduced to sign counts per (panel, predictor, gene), in
    which a null effect counts as a row but not towards the share. The score
    rows of the top pathways are few (k per panel, times predictors); their size
    at run time decides how they meet the effects. The genes of the largest
    panel and predictor are counted: beyond PART_GENES all genes are dealt to
    parts by hash and the score rows repeated for each part, so that no task
    holds a panel. Score rows that meet no effect form a null-gene group.
    """
    wanted = top.join(scores, PANEL + ["pathway"], "left").select(
        *PANEL, "pathway", "predictor", F.signum("stat").alias("__sign")
    )
    rows = effects.withColumnRenamed("path_short", "predictor")
    signs = checkpointed(rows.groupBy(*PANEL, "predictor", "gene").agg(
        F.count_if(F.col("logFC") > 0).alias("__up"),
        F.count_if(F.col("logFC") < 0).alias("__down"),
        F.count_if(F.col("logFC") == 0).alias("__zero"),
        F.count("*").alias("__rows"),
    ))
    seen = checkpointed(signs.groupBy(*PANEL, "predictor").agg(F.count("*").alias("__genes")))
    parts = -(-(seen.agg(F.max("__genes")).first()[0] or 1) // PART_GENES)
    same = (
        F.when(F.col("__sign") > 0, F.col("__up"))
        .when(F.col("__sign") < 0, F.col("__down"))
        .when(F.col("__sign") == 0, F.col("__zero"))
    )
    known = F.when(F.col("__sign").isNotNull(), F.col("__up") + F.col("__down") + F.col("__zero"))
    met = _dealt(signs, wanted, parts).select(
        *PANEL, "pathway", "gene",
        same.alias("__same"), known.alias("__known"), F.col("__rows"),
    )
    unmet = wanted.join(seen, PANEL + ["predictor"], "left_anti").select(
        *PANEL, "pathway",
        F.lit(None).cast("string").alias("gene"),
        F.lit(None).cast("bigint").alias("__same"),
        F.lit(None).cast("bigint").alias("__known"),
        F.lit(1).cast("bigint").alias("__rows"),
    )
    return (
        met.unionByName(unmet)
        .groupBy(*PANEL, "pathway", "gene")
        .agg(
            F.try_divide(F.sum("__same"), F.sum("__known")).alias("agree"),
            F.sum("__rows").alias("n"),
        )
    )


def _dealt(signs: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """Sign counts and score rows of the same panel and predictor, in parts by gene."""
    if parts == 1:
        return signs.join(wanted, PANEL + ["predictor"])
    part = F.pmod(F.xxhash64("gene"), F.lit(parts)).cast("int")
    repeated = wanted.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return signs.withColumn("__part", part).join(repeated, [*PANEL, "predictor", "__part"])


def sign_drivers(
    top: DataFrame, scores: DataFrame, effects: DataFrame, min_n: int = 3, n: int = 15
) -> DataFrame:
    """The n items of best agreement per top pathway, with at least min_n rows."""
    agreement = sign_agreement(top, scores, effects).filter(F.col("n") >= min_n)
    return top_n_per_group(
        agreement, PANEL + ["pathway"],
        [F.desc_nulls_last("agree"), F.asc_nulls_last("gene")], n,
    )


def drivers_focus(leading: DataFrame, pattern: str, n: int = 10, width: int = 50) -> DataFrame:
    """Best items per shortened pathway label, for labels with a keyword."""
    labelled = leading.withColumn("path_label", pathway_label(F.col("pathway"), width))
    return top_n_per_group(
        labelled.filter(matches(F.col("path_label"), pattern, ignore_case=True)),
        PANEL + ["path_label"],
        [F.desc_nulls_last("agree"), F.asc("pathway"), F.asc_nulls_last("gene")], n,
    )


def drivers_for(
    leading: DataFrame, cell: str, pattern: str, n: int = 15, ignore_case: bool = True
) -> DataFrame:
    """Look-up: best items per sex in one cell type whose pathway label matches."""
    require_columns(leading, [*PANEL, "pathway", "gene", "agree", "n"])
    hits = leading.withColumn("path_clean", pathway_label(F.col("pathway"))).filter(
        (F.col("cell_major") == cell) & matches(F.col("path_clean"), pattern, ignore_case)
    )
    return top_n_per_group(
        hits, ["sex"],
        [F.desc_nulls_last("agree"), F.asc("pathway"), F.asc_nulls_last("gene")], n,
    )


def driver_examples(leading: DataFrame, cell: str, n: int = 10) -> DataFrame:
    """Up to n pathway labels that the look-up could have matched."""
    return (
        leading.filter(F.col("cell_major") == cell)
        .select(pathway_label(F.col("pathway")).alias("path_clean"))
        .distinct()
        .orderBy("path_clean")
        .limit(n)
    )
