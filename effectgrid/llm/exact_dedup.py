"""Exact dedup by content-defined chunk recipes.

A text, with A-Z lower-cased and in UTF-8, is cut where a rolling hash of the
last 32 bytes meets a condition, so equal stretches are cut alike wherever
they begin. Chunks are deduplicated by digest, and each digest is verified: its
smallest and largest content must be the same bytes. Where they are not, the
contents of that digest are numbered, so an identifier always stands for one
content. A text's recipe is the ordered list of its chunk identifiers. Two
texts are equal when their recipes are; only recipes are compared, and each
chunk's content moves once at most from a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effectgrid.llm.tables import only, stored
from effectgrid.llm.words import LOWER, U64, pieces, salt

LEAST, MEAN_BITS, MOST = 256, 10, 8192
_GEAR = np.array([salt(5000 + i) for i in range(256)], U64)


def cut_points(low: np.ndarray) -> np.ndarray:
    """Where the chunks of one text end, from its lower-cased bytes.

    A cut depends on the 32 bytes before it and on the chunk's begin only:
    chunks have LEAST to MOST bytes, the last one may be shorter.
    """
    n = len(low)
    if n <= LEAST:
        return np.array([n]) if n else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        rolling, span = _GEAR[low], 1
        while span < 32:  # doubles the window: h(2k) at i is h(k) at i + h(k) at i - k, shifted
            later = rolling.copy()
            later[span:] += rolling[:-span] << U64(span)
            rolling, span = later, 2 * span
    wanted = np.flatnonzero(rolling >> U64(64 - MEAN_BITS) == 0) + 1
    ends, begin = [], 0
    while begin < n:
        k = np.searchsorted(wanted, begin + LEAST)
        end = int(wanted[k]) if k < len(wanted) else n
        end = min(end, begin + MOST, n)
        ends.append(end)
        begin = end
    return np.array(ends)


def _digest(content: bytes, bits: int) -> int:
    """A signed 64-bit digest, or fewer bits in tests of the verification."""
    n = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)
    return n if bits == 64 else n & ((1 << bits) - 1)


def _chunks(column: pa.Array, bits: int):
    """Per text: i, its lower-cased bytes, [(digest, content)]."""
    for i, _, data, offsets in pieces(column):
        low = LOWER[data]
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            whole, at, out = low[a:b], 0, []
            text = whole.tobytes()
            for end in cut_points(whole):
                out.append((_digest(text[at:end], bits), text[at:end]))
                at = int(end)
            yield i + k, text, out


def _recipes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes, sums = [], []
            for _, text, parts in _chunks(batch.column(1), bits):
                recipes.append([d for d, _ in parts])
                sums.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(recipes, pa.list_(pa.int64())), pa.array(sums, pa.string())],
                ["id", "recipe", "text_sha256"],
            )

    return run


def _contents(bits: int):
    """The chunks of a task, each once for a stretch of texts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], None] = {}
        held = 0

        def out():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in seen], pa.int64()), pa.array([c for _, c in seen], pa.binary())], ["digest", "content"]
            )

        for batch in batches:
            for _, _, parts in _chunks(batch.column(1), bits):
                for part in parts:
                    if part not in seen:
                        seen[part] = None
                        held += len(part[1])
                if held > 1 << 24:
                    yield from out()
                    seen, held = {}, 0
        if seen:
            yield from out()

    return run


def recipes(docs: DataFrame, digest_bits: int = 64) -> DataFrame:
    """(id, recipe, text_sha256) of frames (id, text); a recipe names verified chunk identifiers in order."""
    docs = docs.select("id", "text")
    plain = docs.mapInArrow(_recipes(digest_bits), "id long, recipe array<long>, text_sha256 string")
    chunks = docs.mapInArrow(_contents(digest_bits), "digest long, content binary")
    # min and max are combined in the map tasks, so a chunk of a third of all texts moves once a task
    clash = stored(
        chunks.groupBy("digest")
        .agg(F.min("content").alias("low"), F.max("content").alias("high"))
        .where("low <> high")
        .select("digest")
    )
    listed = F.transform("recipe", lambda d: F.struct(d.alias("digest"), F.lit(0).alias("n")))
    if clash.isEmpty():  # every digest stands for one content
        return plain.withColumn("recipe", listed)
    # contents of a digest with several are numbered; their texts name digest and number
    several = chunks.join(clash, "digest", "left_semi").distinct()
    numbered = stored(several.withColumn("n", F.row_number().over(Window.partitionBy("digest").orderBy("content"))))
    pieces_of = docs.mapInArrow(_placed(digest_bits), "id long, at int, digest long, content binary")
    fixes = pieces_of.join(clash, "digest", "left_semi").join(numbered, ["digest", "content"]).groupBy("id")
    fixes = fixes.agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("fixes"))
    patched = F.transform(
        "recipe",
        lambda d, at: F.struct(d.alias("digest"), F.coalesce(F.try_element_at("fixes", at.cast("int")), F.lit(0)).alias("n")),
    )
    return plain.join(fixes, "id", "left").select("id", patched.alias("recipe"), "text_sha256")


def _placed(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], at, d, c) for i, _, parts in _chunks(batch.column(1), bits) for at, (d, c) in enumerate(parts)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "at", "digest", "content"])

    return run


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest_bits: int = 64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal ones the
    row with the largest id stays. Null counts as empty; empty texts are equal
    to each other. ids are integers without repeats; a null id stays only in a
    group of null ids. Other columns are not read.
    """
    docs = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    lists = stored(recipes(docs, digest_bits))
    groups = lists.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return lists.join(groups, "recipe").select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Rows of one id, null included, stay together if one of them stays.
    """
    kept = exact_groups(only(docs, id_column, text_column), id_column, text_column).where("kept")
    kept = kept.select(F.col(id_column).alias("__kept")).distinct()
    return docs.join(kept, F.col(f"`{id_column}`").cast("long").eqNullSafe(F.col("__kept")), "left_semi")
