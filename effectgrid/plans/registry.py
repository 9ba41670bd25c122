"""The queries on the test tables, by name: (spark, folder) -> DataFrame."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectgrid.operators import (
    association, checks, counts, drivers, fdr, filters, genesets, matrix,
)
from effectgrid.operators.pseudobulk import donor_first_rows
from effectgrid.plans import effects as fx
from effectgrid.plans import links
from effectgrid.plans import scores as sc
from effectgrid.session import checkpointed
from effectgrid.sources import tables, views
from effectgrid.study import TABLES_STUDY as STUDY

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Named columns rounded, the way the oracles round them."""
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# ---- shared inputs -------------------------------------------------------


def _sig(spark: SparkSession, sf: str) -> DataFrame:
    return fx.significant_rows(views.effects(spark, sf), views.annotations(spark, sf), STUDY)


def _on_effects(plan) -> Query:
    return lambda spark, sf: plan(views.effects(spark, sf), views.annotations(spark, sf))


def _on_sig(plan) -> Query:
    return lambda spark, sf: plan(_sig(spark, sf))


def _on_revised(plan) -> Query:
    return lambda spark, sf: plan(views.revised_observations(spark, sf))


def _on_obs(plan) -> Query:
    return lambda spark, sf: plan(views.observations(spark, sf))


def _bulk(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo-bulk with phenotypes: read several times below, so made once."""
    return checkpointed(sc.bulk_with_pheno(views.observations(spark, sf), STUDY))


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo-bulk rows with the site of the donor, for models in which the id repeats."""
    site = views.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("projid"), F.col("c_nationkey").alias("site")
    )
    return checkpointed(
        sc.bulk_with_pheno(views.observations(spark, sf), STUDY).join(site, "projid", "left")
    )


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Signed association scores: one row per model, read several times below."""
    return checkpointed(sc.signed_scores(sc.res_path(_bulk(spark, sf), STUDY)))


def _interaction_scores(spark: SparkSession, sf: str) -> DataFrame:
    return checkpointed(sc.interaction_rows(_bulk(spark, sf), STUDY))


def _leading(spark: SparkSession, sf: str, distinct_items: bool = True) -> DataFrame:
    return links.leading(
        _scores(spark, sf), views.effects(spark, sf), views.annotations(spark, sf), STUDY, distinct_items
    )


# ---- effect rows ---------------------------------------------------------


def stacked_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.effects(spark, sf)
    stacked = tables.stack_named(
        {
            "female_contrast": rows.filter(F.col("sex") == "Female"),
            "male_contrast": rows.filter(F.col("sex") == "Male").drop("sex"),
        }
    )
    return counts.frequency(stacked, ["idx", "list_name", "sex"])


def gene_set_members(effects: DataFrame, annot: DataFrame) -> DataFrame:
    return genesets.gene_set(effects, annot, STUDY.terms, STUDY.prefix)


def gene_set_algebra(effects: DataFrame, annot: DataFrame) -> DataFrame:
    """The same set by union and intersection of symbol tables."""
    combined = genesets.combined_set(
        genesets.annotated(annot, STUDY.terms), genesets.with_prefix(effects, STUDY.prefix)
    )
    return genesets.observed_set(combined, effects)


def set_members_by_cell(effects: DataFrame, annot: DataFrame) -> DataFrame:
    """Effect rows of a ready-made gene set, counted per cell type and sex.

    Rows are counted per gene before they meet the set, so no raw row is shuffled.
    """
    members = gene_set_members(effects, annot)
    keys = ["cell_major", "sex"]
    per_gene = counts.frequency(fx.conform(effects, STUDY), [*keys, "gene"])
    return filters.in_set(per_gene, members, "gene").groupBy(*keys).agg(F.sum("n").alias("n"))


def contrast_files(spark: SparkSession, sf: str) -> DataFrame:
    """Tables read as a list of named files or folders in one scan, counted by name."""
    schema = T.StructType(
        [T.StructField("c_custkey", T.LongType()), T.StructField("s_suppkey", T.LongType())]
    )
    rows = tables.read_contrasts(spark, [f"{sf}/customer.parquet", f"{sf}/supplier.parquet"], schema)
    return rows.groupBy("list_name").agg(
        F.count("*").alias("n"), F.sum("c_custkey").alias("customers"), F.sum("s_suppkey").alias("suppliers")
    )


def source_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a view, of a path where the view is absent, of a derived table where both are."""
    views.table(spark, sf, "nation").createOrReplaceTempView("effectgrid_nations")
    derived = views.table(spark, sf, "customer").select("c_nationkey").distinct()
    absent = f"{sf}/no_such_table.parquet"
    found = {
        "view": tables.first_available(spark, "effectgrid_nations", f"{sf}/part.parquet", derived),
        "path": tables.first_available(spark, "effectgrid_absent", f"{sf}/part.parquet", derived),
        "derived": tables.first_available(spark, "effectgrid_absent", absent, derived),
    }
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("source"), "n") for k, df in found.items()]
    return functools.reduce(DataFrame.unionByName, counted)


def term_closure(spark: SparkSession, sf: str) -> DataFrame:
    edges, roots, direct = views.hierarchy(spark, sf)
    return genesets.members_with_descendants(edges, roots, direct)


def sig_rows(sig: DataFrame) -> DataFrame:
    return sig.select("gene", "cell_major", "path_short", "sex", "logFC", "adj_p")


def bh_by_group(effects: DataFrame, annot: DataFrame) -> DataFrame:
    """FDR of raw effect p-values within (cell, pathology); groups without a bound."""
    rows = fx.in_gene_set(effects, annot, STUDY)
    keys = ["cell_major", "path_short"]
    done = fdr.bh_adjust(rows.select("gene", *keys, "sex", "logFC", "adj_p"), "adj_p", keys)
    return rounded(done, FDR=9)


def bh_global(effects: DataFrame, annot: DataFrame) -> DataFrame:
    rows = fx.conform(effects, STUDY).select("gene", "cell_major", "path_short", "logFC", "adj_p")
    return rounded(fdr.bh_adjust(rows, "adj_p"), FDR=9)


def effect_matrix_wide(effects: DataFrame, annot: DataFrame) -> DataFrame:
    cells = [
        "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD",
        "MACHINERY_A", "MACHINERY_N", "MACHINERY_R",
    ]
    columns = [f"{c}|{s}" for c in cells for s in STUDY.sex_levels]
    wide = fx.effect_matrix_wide(effects, annot, STUDY, columns)
    return wide.select("gene", *[F.round(f"`{c}`", 6).alias(c.replace("|", "_")) for c in columns])


def matrix_names(effects: DataFrame, annot: DataFrame) -> DataFrame:
    return checks.bad_names(fx.effect_matrix(effects, annot, STUDY), "gene")


def _vector_matrix(spark: SparkSession, sf: str) -> DataFrame:
    best = matrix.variance_top_matrix(
        views.vectors(spark, sf), "item", "dim", "value", n=STUDY.matrix_rows, cap=0.3
    )
    return checkpointed(best)


# ---- score tables --------------------------------------------------------


def pseudobulk(obs: DataFrame) -> DataFrame:
    table = sc.pseudobulk_table(obs, STUDY)
    return rounded(table, **{c: 8 for c in table.columns if c not in sc.BULK_KEYS})


def donor_pheno(obs: DataFrame) -> DataFrame:
    present, _ = sc.phenotype_columns(obs, STUDY)
    return rounded(sc.donor_pheno(obs, STUDY), **{c: 6 for c in present})


def donor_first_in_file(spark: SparkSession, sf: str) -> DataFrame:
    """Each donor's first order as the file has them: price, priority and date of that row."""
    rows = tables.read_in_order(spark, f"{sf}/orders.parquet").withColumn("projid", F.col("o_custkey").cast("string"))
    chosen = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    first = donor_first_rows(rows, "projid", chosen, "file_order")
    return rounded(first, o_totalprice=2)


def donor_pheno_first(obs: DataFrame) -> DataFrame:
    """First row per donor in the order of order key and line."""
    present, _ = sc.phenotype_columns(obs, STUDY)
    ordered = obs.withColumn("row_order", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(sc.donor_pheno_first(ordered, STUDY, "row_order"), **{c: 6 for c in present})


def donor_check(obs: DataFrame) -> DataFrame:
    return checks.repeated_keys(sc.donor_pheno(obs, STUDY), ["projid"])


def missing_phenotypes(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted phenotype names without a column, as rows next to the table size."""
    obs = views.observations(spark, sf)
    _, missing = sc.phenotype_columns(obs, STUDY)
    return checks.row_count(obs).select(
        F.explode(F.array(*[F.lit(m) for m in missing])).alias("missing"), "n_rows"
    )


def bulk_pheno(obs: DataFrame) -> DataFrame:
    table = sc.bulk_with_pheno(obs, STUDY)
    present, _ = sc.phenotype_columns(obs, STUDY)
    return rounded(
        table, **{c: 6 if c in present else 8 for c in table.columns if c not in sc.BULK_KEYS}
    )


def standardised(obs: DataFrame) -> DataFrame:
    """Donor balance scaled within cell type and sex, one row per donor and group."""
    rows = sc.conform(obs, STUDY).select("projid", *sc.PANEL, "acctbal").distinct()
    return rounded(association.standardise(rows, "acctbal", sc.PANEL, "scaled"), scaled=6)


def assoc(spark: SparkSession, sf: str) -> DataFrame:
    fits = sc.associations(_bulk(spark, sf), STUDY)
    return rounded(fits, estimate=4, std_error=4, statistic=6, p_value=6)


def assoc_fdr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sc.res_path(_bulk(spark, sf), STUDY), beta=4, se=4, p=6, FDR=6)


def assoc_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Random intercept per site: sites have many donors."""
    fits = sc.associations(_sites(spark, sf), STUDY, ident="site")
    return rounded(fits, estimate=4, std_error=4, statistic=4)


def interaction_mixed(spark: SparkSession, sf: str) -> DataFrame:
    fits = sc.interactions(_sites(spark, sf), STUDY, ident="site")
    return rounded(fits, estimate=4, std_error=4, p_value=6)


def signed_score(spark: SparkSession, sf: str) -> DataFrame:
    keys = [*sc.PANEL, "predictor", "pathway"]
    scores = _scores(spark, sf)
    first = sc.signed_scores_grouped(scores).withColumnRenamed("stat", "stat_grouped")
    return rounded(scores.select(*keys, "stat").join(first, keys), stat=5, stat_grouped=5)


def pathway_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sc.pathway_keyword(_scores(spark, sf), STUDY), stat=5)


def _report(df: DataFrame) -> DataFrame:
    places = {"beta": 4, "se": 4, "p": 6, "FDR": 6, "stat": 5, "max_abs": 5}
    return rounded(df, **{c: n for c, n in places.items() if c in df.columns})


def sex_contrast(spark: SparkSession, sf: str) -> DataFrame:
    table = sc.sex_contrast(_scores(spark, sf), STUDY)
    values = ["m_female", "sd_female", "m_male", "sd_male", "delta", "se", "ci"]
    return rounded(table, **{c: 5 for c in values})


def interaction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sc.interactions(_bulk(spark, sf), STUDY), estimate=4, std_error=4, p_value=6)


def interaction_fdr(spark: SparkSession, sf: str) -> DataFrame:
    table = _interaction_scores(spark, sf)
    return rounded(table, estimate=4, std_error=4, p_value=6, FDR=6, stat=5)


def interaction_top(spark: SparkSession, sf: str) -> DataFrame:
    table = sc.interaction_top(_interaction_scores(spark, sf), STUDY)
    return rounded(table, estimate=4, std_error=4, p_value=6, FDR=6, stat=5, max_abs=5)


def interaction_top_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """No pathway reaches this threshold, so the strongest ones count as they are."""
    study = dataclasses.replace(STUDY, interaction_threshold=1e9)
    table = sc.interaction_top(_interaction_scores(spark, sf), study)
    return rounded(table, estimate=4, std_error=4, p_value=6, FDR=6, stat=5, max_abs=5)


def interaction_top_rows(spark: SparkSession, sf: str) -> DataFrame:
    return checks.row_count(sc.interaction_top(_interaction_scores(spark, sf), STUDY))


# ---- links ---------------------------------------------------------------


def lead(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_leading(spark, sf), agree=6)


def lead_as_written(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_leading(spark, sf, distinct_items=False), agree=6)


def lead_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(links.leading_report(_leading(spark, sf)), agree=6)


def lead_focus(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        drivers.drivers_focus(_leading(spark, sf), STUDY.driver_keywords, STUDY.drivers_label_n), agree=6
    )


def lead_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(drivers.drivers_for(_leading(spark, sf), "BUILDING", "order share|price"), agree=6)


def lead_lookup_none(spark: SparkSession, sf: str) -> DataFrame:
    """The label has lost prefix and underscores, so this pattern finds nothing."""
    return drivers.drivers_for(_leading(spark, sf), "AUTOMOBILE", "^REACTOME_PRICE$")


def lead_examples(spark: SparkSession, sf: str) -> DataFrame:
    return drivers.driver_examples(_leading(spark, sf), "AUTOMOBILE")


QUERIES: dict[str, Query] = {
    "stacked_sources": stacked_sources,
    "label_counts": _on_effects(lambda e, a: fx.label_counts(e, STUDY)),
    "cell_counts": _on_effects(lambda e, a: fx.cell_counts(e, STUDY)),
    "gene_set": _on_effects(gene_set_members),
    "gene_set_algebra": _on_effects(gene_set_algebra),
    "set_members_by_cell": _on_effects(set_members_by_cell),
    "gene_set_sizes": _on_effects(
        lambda e, a: genesets.gene_set_sizes(e, a, STUDY.terms, STUDY.prefix)
    ),
    "term_closure": term_closure,
    "contrast_files": contrast_files,
    "source_fallback": source_fallback,
    "sig_rows": _on_sig(sig_rows),
    "sig_by_cell": _on_sig(fx.sig_by_cell),
    "sig_by_cell_path": _on_sig(lambda s: fx.sig_by_cell_path(s, STUDY)),
    "sig_boxstats": _on_sig(lambda s: fx.sig_boxstats(s, STUDY)),
    "sig_by_cell_sex": _on_sig(lambda s: fx.sig_by_cell_sex(s, STUDY)),
    "sig_heatmap": _on_sig(lambda s: rounded(fx.sig_heatmap(s, STUDY), med_lfc=6, med_lfc_cap=6)),
    "sig_heatmap_sex": _on_sig(
        lambda s: rounded(fx.sig_heatmap_sex(s, STUDY), med_lfc=6, med_lfc_cap=6)
    ),
    "direction_ratio": _on_sig(lambda s: rounded(fx.direction_ratio(s), log2_up_down=6)),
    "recurrence_top": _on_sig(lambda s: fx.recurrence_top(s, STUDY)),
    "recurrence_top_by_limit": _on_sig(lambda s: fx.recurrence_top_by_limit(s, STUDY)),
    "sex_exclusive_fisher": _on_sig(
        lambda s: rounded(fx.sex_exclusive_fisher(s), p_fisher=6, logOR=6)
    ),
    "sex_enrichment": _on_effects(
        lambda e, a: rounded(fx.sex_enrichment(e, a, STUDY), pval=6, logOR=6, nlog10p=6)
    ),
    "bh_by_group": _on_effects(bh_by_group),
    "bh_global": _on_effects(bh_global),
    "effect_matrix": _on_effects(lambda e, a: rounded(fx.effect_matrix(e, a, STUDY), logFC=6)),
    "effect_matrix_wide": _on_effects(effect_matrix_wide),
    "matrix_names": _on_effects(matrix_names),
    "row_distance": _on_effects(lambda e, a: rounded(fx.row_distance(e, a, STUDY), dist=6)),
    "column_distance": _on_effects(lambda e, a: rounded(fx.column_distance(e, a, STUDY), dist=6)),
    "vector_row_distance": lambda spark, sf: rounded(
        matrix.pairwise_distance(_vector_matrix(spark, sf), "item", "dim", "value"), dist=6
    ),
    "vector_column_distance": lambda spark, sf: rounded(
        matrix.pairwise_distance(_vector_matrix(spark, sf), "dim", "item", "value"), dist=6
    ),
    "obs_profile": _on_obs(
        lambda o: rounded(sc.obs_profile(o, STUDY), min=6, q1=6, median=6, mean=4, q3=6, max=6)
    ),
    "pseudobulk": _on_obs(pseudobulk),
    "donor_pheno": _on_obs(donor_pheno),
    "donor_pheno_first": _on_obs(donor_pheno_first),
    "donor_first_in_file": donor_first_in_file,
    "donor_check": _on_obs(donor_check),
    "donor_check_revised": _on_revised(donor_check),
    "donor_pheno_first_revised": _on_revised(donor_pheno_first),
    "bulk_pheno_revised": _on_revised(bulk_pheno),
    "missing_phenotypes": missing_phenotypes,
    "bulk_pheno": _on_obs(bulk_pheno),
    "standardised": _on_obs(standardised),
    "assoc": assoc,
    "assoc_fdr": assoc_fdr,
    "assoc_mixed": assoc_mixed,
    "signed_score": signed_score,
    "pathway_keyword": pathway_keyword,
    "top_pathways": lambda spark, sf: _report(sc.top_pathways(_scores(spark, sf), STUDY)),
    "focus_pathways": lambda spark, sf: _report(sc.focus_pathways(_scores(spark, sf), STUDY)),
    "strength_crosstab": lambda spark, sf: sc.strength_crosstab(_scores(spark, sf), STUDY),
    "sex_contrast": sex_contrast,
    "interaction": interaction,
    "interaction_mixed": interaction_mixed,
    "interaction_fdr": interaction_fdr,
    "interaction_top": interaction_top,
    "interaction_top_fallback": interaction_top_fallback,
    "interaction_top_rows": interaction_top_rows,
    "drivers": lead,
    "drivers_as_written": lead_as_written,
    "drivers_report": lead_report,
    "drivers_focus": lead_focus,
    "drivers_for": lead_lookup,
    "drivers_for_none": lead_lookup_none,
    "driver_examples": lead_examples,
}
