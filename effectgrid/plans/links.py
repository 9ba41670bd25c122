"""Queries that link the strongest pathways back to effect rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.operators import drivers, filters
from effectgrid.plans import effects as effect_plans
from effectgrid.plans import scores as score_plans
from effectgrid.study import Study


def leading(
    scores: DataFrame, effects: DataFrame, annot: DataFrame, study: Study, distinct_items: bool = True
) -> DataFrame:
    """Leading items per top pathway of the focus cells."""
    focus = score_plans.focus_scores(scores, study)
    top = drivers.top_items(score_plans.focus_pathways(scores, study), study.drivers_k, distinct_items)
    # predictors come from the phenotype list, so it restricts the scan as well
    listed = filters.of_pathologies(effects, study.phenotypes)
    rows = effect_plans.in_gene_set(listed, annot, study).filter(
        F.col("cell_major").isin(study.focus_cells)
    )
    return drivers.sign_drivers(top, focus, rows, study.drivers_min_n, study.drivers_n)


def leading_report(lead: DataFrame, n: int = 100) -> DataFrame:
    return lead.orderBy(
        "cell_major", "sex", "pathway", F.desc_nulls_last("agree"), F.asc_nulls_last("gene")
    ).limit(n)
