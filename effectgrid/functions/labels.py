"""Label clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from effectgrid.study import LABEL_PREFIX


def strip_suffix(col: Column, suffix: str = ".scaled") -> Column:
    return F.when(
        col.endswith(suffix), F.substring(col, F.lit(1), F.length(col) - len(suffix))
    ).otherwise(col)


def normalise_cell(col: Column) -> Column:
    """Dots to underscores; the prefix InN, alone or before an underscore, to Inh."""
    return F.regexp_replace(F.translate(col, ".", "_"), r"^InN(?=_|\b)", "Inh")


def major_cell(col: Column, levels: list[str]) -> Column:
    """First level that is a prefix of the label, else the label itself.

    One expression with a single use of `col`: a filter on the result is
    copied towards the scan without multiplying the label work.
    """
    prefixes = "|".join(rf"\Q{level}\E" for level in levels)
    return F.regexp_replace(col, f"(?s)^({prefixes}).*$", "$1")


def closed_level(col: Column, levels: list[str]) -> Column:
    """Values outside the level list become null."""
    return F.when(col.isin(levels), col)


def level_ordinal(col: Column, levels: list[str]) -> Column:
    """1-based position in the level list, null outside it."""
    return F.nullif(
        F.array_position(F.array(*[F.lit(v) for v in levels]), col), F.lit(0).cast("bigint")
    )


def truncate(col: Column, width: int) -> Column:
    return F.when(
        F.length(col) > width, F.concat(F.substring(col, 1, width - 3), F.lit("..."))
    ).otherwise(col)


def pathway_label(col: Column, width: int | None = None) -> Column:
    """Drop the collection prefix, turn underscores into spaces, truncate."""
    clean = F.translate(F.regexp_replace(col, LABEL_PREFIX, ""), "_", " ")
    return clean if width is None else truncate(clean, width)


def join_key(*cols: Column, sep: str = "|") -> Column:
    """Joined text key in which a null part reads as the text NA."""
    return F.concat_ws(sep, *[F.coalesce(c, F.lit("NA")) for c in cols])


def key_head(col: Column) -> Column:
    """Text before the first bar."""
    return F.regexp_replace(col, r"\|.*$", "")


def key_tail(col: Column) -> Column:
    """Text after the last bar."""
    return F.regexp_replace(col, r"^.*\|", "")


def binary_sex(col: Column) -> Column:
    """1 is male, any other value female, null stays null."""
    return F.when(col.isNotNull(), F.when(col == 1, "male").otherwise("female"))
