"""Item sets from annotations, and closure over a term hierarchy."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.operators.filters import matches
from effectgrid.session import checkpointed


def annotated(annot: DataFrame, terms: list[str], term: str = "goall", symbol: str = "symbol") -> DataFrame:
    """Distinct symbols annotated to any of the terms."""
    return (
        annot.filter(F.col(term).isin(terms) & F.col(symbol).isNotNull())
        .select(F.col(symbol).alias("symbol"))
        .distinct()
    )


def combined_set(*sets: DataFrame) -> DataFrame:
    """Distinct union of symbol tables."""
    return functools.reduce(lambda a, b: a.union(b), sets).distinct()


def with_prefix(items: DataFrame, pattern: str, item: str = "gene") -> DataFrame:
    return items.select(F.col(item).alias("symbol")).filter(matches(F.col("symbol"), pattern)).distinct()


def observed_set(members: DataFrame, items: DataFrame, item: str = "gene") -> DataFrame:
    """Symbols of a set that occur in the table."""
    return members.intersect(items.select(F.col(item).alias("symbol")))


def _set_flags(effects: DataFrame, annot: DataFrame, terms: list[str], prefix: str) -> DataFrame:
    """One row per symbol: annotated, with the prefix, observed. One pass over the effects."""
    by_term = annotated(annot, terms).select(
        "symbol", F.lit(1).alias("term"), F.lit(0).alias("pre"), F.lit(0).alias("seen")
    )
    by_row = effects.select(
        F.col("gene").alias("symbol"),
        F.lit(0).alias("term"),
        matches(F.col("gene"), prefix).cast("int").alias("pre"),
        F.lit(1).alias("seen"),
    ).filter(F.col("symbol").isNotNull())
    return by_term.union(by_row).groupBy("symbol").agg(
        *[(F.max(c) == 1).alias(c) for c in ("term", "pre", "seen")]
    )


def gene_set(effects: DataFrame, annot: DataFrame, terms: list[str], prefix: str) -> DataFrame:
    """Annotated items and items with the prefix, as far as observed."""
    flags = _set_flags(effects, annot, terms, prefix)
    return flags.filter((F.col("term") | F.col("pre")) & F.col("seen")).select("symbol")


def gene_set_sizes(effects: DataFrame, annot: DataFrame, terms: list[str], prefix: str) -> DataFrame:
    """One row: sizes of the annotated, prefix, combined and observed sets."""
    return _set_flags(effects, annot, terms, prefix).agg(
        F.count_if("term").alias("n_annotated"),
        F.count_if("pre").alias("n_prefix"),
        F.count_if(F.col("term") | F.col("pre")).alias("n_combined"),
        F.count_if((F.col("term") | F.col("pre")) & F.col("seen")).alias("n_observed"),
    )


def keep_gene_set(effects: DataFrame, annot: DataFrame, terms: list[str], prefix: str) -> DataFrame:
    """Effect rows whose gene is in the gene set.

    A row of the table is observed by definition, and the prefix test needs
    no look-up, so only the annotated symbols are joined.
    """
    flagged = annotated(annot, terms).select(F.col("symbol").alias("gene"), F.lit(True).alias("__in"))
    return (
        effects.join(flagged, "gene", "left")
        .filter(F.col("__in").isNotNull() | matches(F.col("gene"), prefix))
        .drop("__in")
    )


def descendants(edges: DataFrame, roots: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(root, term) for every root and each term below it, the root included.

    By doubling: `jumps` holds the ends of all walks of 2^k steps, `found` what
    walks of fewer steps reach. Found terms and where the jumps take them are what
    twice as many steps reach, so a hierarchy of n levels takes about log2(n)
    rounds of two joins. A round without a new term ends it: a term further away
    has one on its shortest path in reach of that round, cycles or not. Both tables
    are checkpointed each round, which keeps the plan short and survives lost
    executors.
    """
    jumps = checkpointed(
        edges.select(F.col(parent).alias("__from"), F.col(child).alias("__to")).dropna().distinct()
    )
    found = checkpointed(roots.select(F.col("term").alias("root"), F.col("term").alias("term")).distinct())
    while True:
        reached = (
            found.join(jumps, found["term"] == jumps["__from"]).select("root", F.col("__to").alias("term")).distinct()
        )
        fresh = checkpointed(reached.join(found, ["root", "term"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = checkpointed(found.union(fresh))
        further = jumps.select(F.col("__from").alias("__via"), F.col("__to").alias("__end"))
        jumps = checkpointed(
            jumps.join(further, F.col("__to") == F.col("__via")).select("__from", F.col("__end").alias("__to")).distinct()
        )


def members_with_descendants(
    edges: DataFrame, roots: DataFrame, direct: DataFrame, term: str = "term", symbol: str = "symbol"
) -> DataFrame:
    """Distinct (root, symbol) for direct annotations of a root or any term below."""
    return (
        direct.filter(F.col(symbol).isNotNull())
        .join(descendants(edges, roots), term)
        .select("root", symbol)
        .distinct()
    )
