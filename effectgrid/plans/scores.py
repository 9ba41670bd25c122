"""Queries over wide score tables: pseudo-bulk, association, interaction, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.functions import labels, scalars, special
from effectgrid.operators import (
    association, checks, contrast, counts, filters, grid, pseudobulk, topn,
)
from effectgrid.operators.fdr import bh_adjust
from effectgrid.operators.joins import null_safe_join
from effectgrid.operators.quantiles import profile
from effectgrid.sources.tables import rename_if_absent
from effectgrid.study import Study

BULK_KEYS = ["projid", "cell_major", "sex"]
PANEL = ["cell_major", "sex"]
ITEM = PANEL + ["pathway"]


def conform(obs: DataFrame, study: Study, cell: str = "major.celltype.0") -> DataFrame:
    """Closed cell levels, sex from its 0/1 code, subject id as text."""
    return scalars.nan_columns_to_null(obs).withColumns(
        {
            "cell_major": labels.closed_level(scalars.quoted(cell), study.cell_levels),
            "sex": labels.binary_sex(F.col("msex")),
            "projid": F.col("projid").cast("string"),
        }
    )


def score_columns(obs: DataFrame, study: Study) -> list[str]:
    return filters.columns_matching(obs, study.score_pattern)


def phenotype_columns(obs: DataFrame, study: Study) -> tuple[list[str], list[str]]:
    """(present, missing) phenotypes; at least one must be present."""
    present, missing = filters.split_columns(obs, study.phenotypes)
    checks.require_any(present)
    return present, missing


def obs_profile(obs: DataFrame, study: Study) -> DataFrame:
    qc, _ = filters.split_columns(obs, study.qc_columns)
    return profile(obs, score_columns(obs, study) + qc)


def pseudobulk_table(obs: DataFrame, study: Study) -> DataFrame:
    table = conform(obs, study)
    qc, _ = filters.split_columns(table, study.qc_columns)
    return pseudobulk.pseudobulk(
        table, BULK_KEYS, score_columns(table, study), qc, study.max_cells_per_donor
    )


def donor_pheno(obs: DataFrame, study: Study) -> DataFrame:
    table = conform(obs, study)
    return pseudobulk.donor_rows(table, "projid", phenotype_columns(table, study)[0])


def donor_pheno_first(obs: DataFrame, study: Study, order: str) -> DataFrame:
    table = conform(obs, study)
    return pseudobulk.donor_first_rows(table, "projid", phenotype_columns(table, study)[0], order)


def bulk_with_pheno(obs: DataFrame, study: Study) -> DataFrame:
    """Pseudo-bulk rows with the donor's phenotypes; several donor rows fan out."""
    return pseudobulk_table(obs, study).join(donor_pheno(obs, study), "projid", "left")


def _known_panels(bulk: DataFrame, study: Study) -> DataFrame:
    return bulk.filter(F.col("cell_major").isin(study.cell_levels) & F.col("sex").isin(study.sex_levels))


def associations(bulk: DataFrame, study: Study, ident: str = "projid") -> DataFrame:
    """One row per (cell type, sex, pathway, predictor) model."""
    return association.associate(
        _known_panels(bulk, study), PANEL, score_columns(bulk, study),
        phenotype_columns(bulk, study)[0], study.covariate, ident, study.min_n,
    )


def adjusted(assoc: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """Columns beta, se, p and FDR within (cell type, sex, predictor).

    A missing statistic is estimate over error, a missing p its normal tail.
    A group has one row per score column, a bound the caller can pass.
    """
    z = F.coalesce(F.col("statistic"), F.try_divide("estimate", "std_error"))
    ready = (
        rename_if_absent(assoc, "response", "pathway").withColumns({"sex": F.lower("sex"), "z": z})
        .withColumn("p", F.coalesce(F.col("p_value"), special.normal_two_sided("z")))
        .withColumnsRenamed({"estimate": "beta", "std_error": "se"})
    )
    by = PANEL + ["predictor"]
    return bh_adjust(ready, "p", by, "FDR", max_group_rows).select(
        *PANEL, "predictor", "pathway", "beta", "se", "p", "FDR"
    )


def res_path(bulk: DataFrame, study: Study) -> DataFrame:
    return adjusted(associations(bulk, study), len(score_columns(bulk, study)))


def signed_scores(res: DataFrame) -> DataFrame:
    """sign(beta) * -log10(FDR) per model row."""
    return res.withColumn("stat", scalars.signed_log10(F.col("beta"), F.col("FDR")))


def signed_scores_grouped(res: DataFrame) -> DataFrame:
    """Largest -log10(FDR) per key with the sign of its first row; keys are unique here."""
    keys = PANEL + ["predictor", "pathway"]
    size = scalars.neg_log10(F.col("FDR"), 1e-300)
    return (
        res.filter(F.col("pathway").isNotNull())
        .groupBy(*keys)
        .agg(
            F.max(size).alias("__size"),
            F.min_by(F.signum("beta"), F.struct("beta", "FDR")).alias("__sign"),
        )
        .select(*keys, (F.col("__size") * F.col("__sign") + F.lit(0.0)).alias("stat"))
    )


def pathway_keyword(res: DataFrame, study: Study) -> DataFrame:
    return signed_scores_grouped(res).filter(
        filters.matches(F.col("pathway"), study.keywords, ignore_case=True)
    )


def strongest(scores: DataFrame, study: Study) -> DataFrame:
    """Top pathways per panel by largest absolute score, above the threshold."""
    strength = topn.item_strength(scores, ITEM)
    strength = strength.filter(
        scalars.is_finite(F.col("max_abs")) & (F.col("max_abs") >= study.top_strength)
    )
    return topn.top_n_per_group(
        strength, PANEL, [F.desc_nulls_last("max_abs"), F.asc("pathway")], study.top_n
    )


def top_pathways(scores: DataFrame, study: Study) -> DataFrame:
    """All score rows of the strongest pathways, with labels and their order.

    One inner join keeps the rows and brings the strength along.
    """
    rows = null_safe_join(scores, strongest(scores, study), ITEM)
    labelled = rows.withColumns(
        {
            "pathway_label": labels.pathway_label(F.col("pathway"), 60),
            "panel": labels.join_key(F.col("cell_major"), F.col("sex"), sep="."),
        }
    )
    return grid.panel_order(labelled, ["panel"], "pathway_label", "max_abs", "y_ord")


def focus_scores(scores: DataFrame, study: Study) -> DataFrame:
    return scores.filter(F.col("cell_major").isin(study.focus_cells))


def focus_pathways(scores: DataFrame, study: Study) -> DataFrame:
    """Score rows of the strongest pathways in the focus cells, labels not cut."""
    focus = focus_scores(scores, study)
    rows = null_safe_join(focus, strongest(focus, study), ITEM)
    labelled = rows.withColumn("pathway_label", labels.pathway_label(F.col("pathway")))
    return grid.panel_order(labelled, [], "pathway_label", "max_abs", "y_ord")


def sex_contrast(scores: DataFrame, study: Study) -> DataFrame:
    """Female minus male mean score, largest differences per focus cell."""
    female, male = study.sex_levels
    pairs = contrast.group_contrast(
        focus_scores(scores, study), ["cell_major", "pathway"], "sex", female, male, "stat"
    )
    best = topn.top_n_per_group(
        pairs, ["cell_major"],
        [F.desc_nulls_last(F.abs(F.col("delta"))), F.asc("pathway")], study.contrast_n,
    )
    labelled = best.withColumn("label", labels.pathway_label(F.col("pathway"), 60))
    return grid.panel_order(labelled, ["cell_major"], "label", "delta", "y_ord")


def interactions(bulk: DataFrame, study: Study, ident: str = "projid") -> DataFrame:
    """Sex x predictor interaction per (focus cell, pathway, predictor)."""
    return association.interact(
        bulk.filter(F.col("cell_major").isin(study.focus_cells)), ["cell_major"], "sex",
        study.sex_levels, score_columns(bulk, study), phenotype_columns(bulk, study)[0],
        study.covariate, ident,
    )


def interaction_scores(fits: DataFrame, max_rows: int | None = None) -> DataFrame:
    """FDR over all rows together, and the signed score."""
    return bh_adjust(fits, "p_value", [], "FDR", max_rows).withColumn(
        "stat", scalars.signed_log10(F.col("estimate"), F.col("FDR"))
    )


def interaction_rows(bulk: DataFrame, study: Study) -> DataFrame:
    models = (
        len(study.focus_cells) * len(score_columns(bulk, study)) * len(phenotype_columns(bulk, study)[0])
    )
    return interaction_scores(interactions(bulk, study), models)


def interaction_top(scores: DataFrame, study: Study) -> DataFrame:
    """Score rows of the top pathways per cell, labels, order and predictor order."""
    finite = scores.filter(scalars.is_finite(F.col("stat")))
    strength = topn.item_strength(finite, ["cell_major", "pathway"])
    best = topn.top_n_or_fallback(
        strength, ["cell_major"], "max_abs",
        [F.desc_nulls_last("max_abs"), F.asc("pathway")], study.top_n, study.interaction_threshold,
    )
    rows = scores.join(best, ["cell_major", "pathway"]).withColumn(
        "pathway_label", labels.pathway_label(F.col("pathway"), 55)
    )
    placed = grid.panel_order(rows, ["cell_major"], "pathway_label", "max_abs", "y_ord")
    return grid.peak_order(placed, "predictor", "stat", "pred_ord")


def strength_crosstab(scores: DataFrame, study: Study) -> DataFrame:
    """Pathways per cell type at or above the strength threshold, and below."""
    strength = topn.item_strength(scores, ITEM).filter(F.col("max_abs").isNotNull())
    return counts.cross_table(strength, "cell_major", F.col("max_abs") >= study.top_strength)
