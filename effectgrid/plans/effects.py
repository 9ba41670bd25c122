"""Queries over effect rows: counts, grids, recurrence, enrichment, matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.functions import labels, scalars
from effectgrid.operators import counts, filters, fisher, genesets, grid, matrix, topn
from effectgrid.operators.quantiles import exact_quantiles
from effectgrid.session import checkpointed
from effectgrid.study import Study


def conform(effects: DataFrame, study: Study) -> DataFrame:
    """Missing values unified; short pathology, clean and major cell labels added."""
    clean = labels.normalise_cell(F.col("celltype"))
    return scalars.nan_columns_to_null(effects).withColumns(
        {
            "path_short": labels.strip_suffix(F.col("pathology")),
            "cell_clean": clean,
            "cell_major": labels.major_cell(clean, study.cell_levels),
        }
    )


def in_gene_set(effects: DataFrame, annot: DataFrame, study: Study) -> DataFrame:
    """Conformed rows of the gene set, sex in lower case."""
    kept = genesets.keep_gene_set(conform(effects, study), annot, study.terms, study.prefix)
    return kept.withColumn("sex", F.lower("sex"))


def significant_rows(effects: DataFrame, annot: DataFrame, study: Study) -> DataFrame:
    """Significant rows of the gene set and the listed pathologies, closed cell levels.

    The row filters come first, on the stored columns, so they reach the scan.
    """
    kept = filters.significant(effects, study.alpha, study.lfc_min)
    kept = filters.of_pathologies(kept, study.pathologies)
    return in_gene_set(kept, annot, study).withColumn(
        "cell_major", labels.closed_level(F.col("cell_major"), study.cell_levels)
    )


def label_counts(effects: DataFrame, study: Study, n: int = 20) -> DataFrame:
    return counts.most_frequent(conform(effects, study), ["celltype", "cell_clean", "cell_major"], n)


def cell_counts(effects: DataFrame, study: Study) -> DataFrame:
    return counts.frequency(conform(effects, study), ["cell_major"])


def sig_by_cell(sig: DataFrame) -> DataFrame:
    """Distinct significant items per cell type, most first."""
    return counts.distinct_counts(sig, ["cell_major"]).orderBy(
        F.desc("n_sig"), F.asc_nulls_last("cell_major")
    )


def sig_by_cell_path(sig: DataFrame, study: Study) -> DataFrame:
    counted = counts.distinct_counts(sig, ["cell_major", "path_short"])
    full = grid.complete_grid(
        counted, {"cell_major": study.cell_levels, "path_short": None}, {"n_sig": 0}
    )
    known = full.filter(F.col("cell_major").isNotNull() & F.col("path_short").isNotNull())
    return known.withColumn(
        "cell_ord", labels.level_ordinal(F.col("cell_major"), study.cell_levels)
    )


def sig_boxstats(sig: DataFrame, study: Study) -> DataFrame:
    return counts.box_stats(sig_by_cell_path(sig, study), ["cell_major"], "n_sig")


def sig_by_cell_sex(sig: DataFrame, study: Study) -> DataFrame:
    """Zero-filled counts by sex, for each pathology and for all together."""
    counted = counts.distinct_counts(
        sig, ["path_short", "cell_major", "sex"], overall="path_short"
    )
    return grid.complete_grid(
        counted, {"cell_major": study.cell_levels, "sex": None}, {"n_sig": 0}, by=["path_short"]
    )


def _heatmap(sig: DataFrame, study: Study, extra: list[str]) -> DataFrame:
    known = sig.filter(F.col("cell_major").isNotNull() & F.col("path_short").isNotNull())
    counted = counts.counts_with_median(known, ["cell_major", "path_short", *extra])
    axes = {"cell_major": study.cell_levels, "path_short": None, **{c: None for c in extra}}
    return grid.complete_grid(counted, axes, {"n_sig": 0}).withColumn(
        "med_lfc_cap", scalars.winsorise(F.col("med_lfc"), study.bubble_cap)
    )


def sig_heatmap(sig: DataFrame, study: Study) -> DataFrame:
    """Counts, medians and capped medians on the full grid, with axis orders."""
    cells = grid.level_order(_heatmap(sig, study, []), "cell_major", "n_sig", "row_ord")
    return grid.level_order(cells, "path_short", "n_sig", "col_ord")


def sig_heatmap_sex(sig: DataFrame, study: Study) -> DataFrame:
    return _heatmap(sig, study, ["sex"])


def direction_ratio(sig: DataFrame) -> DataFrame:
    labelled = sig.withColumn("direction", scalars.direction(F.col("logFC"))).filter(
        F.col("direction").isNotNull()
    )
    return counts.direction_ratio(labelled, ["cell_major", "path_short"])


def _recurrent(sig: DataFrame, study: Study) -> DataFrame:
    return counts.recurrence(sig, ["cell_major", "gene"]).filter(F.col("n_path") >= study.min_recur)


def _recurrence_order() -> list:
    return [F.desc("n_path"), F.desc(F.abs(F.col("pos") - F.col("neg"))), F.asc("gene")]


def recurrence_top(sig: DataFrame, study: Study) -> DataFrame:
    """Items significant in several pathologies, a fixed number per cell type."""
    best = topn.top_n_per_group(
        _recurrent(sig, study), ["cell_major"], _recurrence_order(), study.recur_top
    )
    return grid.panel_order(best, ["cell_major"], "gene", "n_path", "y_ord")


def recurrence_top_by_limit(sig: DataFrame, study: Study) -> DataFrame:
    """As above with a number per cell type from the limits table."""
    return topn.top_n_by_limits(
        _recurrent(sig, study), "cell_major", _recurrence_order(), study.recur_limits
    )


def sex_exclusive_fisher(sig: DataFrame) -> DataFrame:
    """Items hit in both sexes or one; log ratio of the exclusive ones; p."""
    tallies = counts.exclusive_tallies(sig, ["cell_major"])
    tested = fisher.fisher_2x2(tallies, "both", "m_only", "f_only", "none", out="p_fisher")
    return tested.withColumn(
        "logOR", F.log((F.col("f_only") + F.lit(0.5)) / (F.col("m_only") + F.lit(0.5)))
    )


def sex_enrichment(effects: DataFrame, annot: DataFrame, study: Study) -> DataFrame:
    """Significant against all items of the set, female against male, per cell type.

    The totals are over every pathology and every cell label; the hits are
    restricted to the listed ones.
    """
    keys = ["cell_major", "sex"]
    counted = (
        filters.is_significant(study.alpha, study.lfc_min)
        & filters.is_of_pathologies(study.pathologies)
        & F.col("cell_major").isin(study.cell_levels)
    )
    # one row per item first: both tallies come from one scan
    items = in_gene_set(effects, annot, study).groupBy(*keys, "gene").agg(
        F.coalesce(F.bool_or(counted), F.lit(False)).alias("__hit")
    )
    return fisher.enrichment_of(
        items.groupBy(*keys).agg(
            F.count("gene").alias("n_total"),
            F.count_if(F.col("__hit") & F.col("gene").isNotNull()).alias("n_sig"),
        )
    )


def effect_cells(effects: DataFrame, annot: DataFrame, study: Study) -> DataFrame:
    """Median significant effect per (gene, cell|sex) for one pathology."""
    kept = filters.significant(effects, study.alpha, study.lfc_min)
    rows = in_gene_set(filters.of_pathologies(kept, [study.matrix_path]), annot, study)
    medians = exact_quantiles(rows, ["gene", "sex", "cell_major"], "logFC", {"logFC": 0.5})
    return medians.withColumn(
        "sex", labels.closed_level(F.col("sex"), study.sex_levels)
    ).withColumn("col_key", labels.join_key(F.col("cell_major"), F.col("sex")))


def effect_matrix(effects: DataFrame, annot: DataFrame, study: Study) -> DataFrame:
    """Long matrix of the most variable genes, clamped, with the column key split."""
    best = matrix.variance_top_matrix(
        effect_cells(effects, annot, study), "gene", "col_key", "logFC",
        study.matrix_rows, study.matrix_cap,
    )
    return best.withColumns(
        {
            "cell_type": labels.key_head(F.col("col_key")),
            "sex": F.lower(labels.key_tail(F.col("col_key"))),
        }
    )


def effect_matrix_wide(effects: DataFrame, annot: DataFrame, study: Study, columns: list[str]) -> DataFrame:
    return matrix.widen(effect_matrix(effects, annot, study), "gene", "col_key", "logFC", columns)


def row_distance(effects: DataFrame, annot: DataFrame, study: Study) -> DataFrame:
    """Distances between the rows of the matrix, which is small and read several times."""
    cells = checkpointed(effect_matrix(effects, annot, study))
    return matrix.pairwise_distance(cells, "gene", "col_key", "logFC")


def column_distance(effects: DataFrame, annot: DataFrame, study: Study) -> DataFrame:
    cells = checkpointed(effect_matrix(effects, annot, study))
    return matrix.pairwise_distance(cells, "col_key", "gene", "logFC")
