"""All links of the n-gram Jaccard join.

The join itself ends when every pair that its sketches allow has been verified
or lies in one component, so two sets that are similar enough are always in one
component, and every link is found inside it. There the sets of different
texts are held against each other in pairs of chunks, dealt over tasks by
component and chunk pair: the members that two sets share are counted for a whole
chunk pair at a time, as products of 0/1 matrices over blocks of the members that
both chunks have. No pair is passed on for a count of links; each task gives
one sum per set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.llm.ngram_join import TEXTS, class_members, sized
from effectgrid.llm.tables import stored
from effectgrid.llm.words import pieces, shingle_sets

#: Sets, and members of sets, in a chunk on average.
CHUNK_SETS, CHUNK_MEMBERS = 256, 1 << 20
#: Members in a block of a product.
COLUMNS = 4096


def shared_members(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right): the members that each two sets have in common. Sets hold each member once."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(left) or not len(right):
        return out
    tokens = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*tokens)
    sides = []
    for sets, token in zip((left, right), tokens):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        here = np.isin(token, common)
        at, row = np.searchsorted(common, token[here]), row[here]
        order = np.argsort(at, kind="stable")
        sides.append((len(sets), at[order], row[order]))
    for low in range(0, len(common), COLUMNS):
        blocks = []
        for n, at, row in sides:
            i, j = np.searchsorted(at, [low, low + COLUMNS])
            block = np.zeros((n, min(COLUMNS, len(common) - low)), np.float32)
            block[row[i:j], at[i:j] - low] = 1
            blocks.append(block)
        out += (blocks[0] @ blocks[1].T).astype(np.int64)  # below 2^24, so exact
    return out


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of neighbouring rows with equal values in the named whole-number columns."""
    held, name = [], None
    for batch in batches:
        at = np.stack([batch.column(batch.schema.names.index(c)).to_numpy().astype(np.int64) for c in names])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), at.shape[1]]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j:
                continue
            if held and tuple(at[:, i].tolist()) != name:
                yield pa.Table.from_batches(held)
                held = []
            name = tuple(at[:, i].tolist())
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _side(rows: pa.Table, shingle: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, copies and sets of a chunk; of repeated ids the first row whose set has the stated size."""
    ids, copies, n = (rows[c].to_numpy() for c in ("id", "copies", "n"))
    sets: list[np.ndarray] = []
    for _, _, data, offsets in pieces(rows["text"].combine_chunks()):
        sets += shingle_sets(data, offsets, shingle)
    good = np.flatnonzero([len(s) == m for s, m in zip(sets, n)])
    at = good[np.unique(ids[good], return_index=True)[1]]
    return ids[at], copies[at], [sets[i] for i in at]


def _linked(threshold: float, shingle: int, as_pairs: bool):
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["component", "i", "j"]):
            side = rows["side"].to_numpy()
            parts = [_side(rows.filter(pa.array(side == k)), shingle) for k in ((0,) if 0 in side else (-1, 1))]
            if len(parts) < 2 and 0 not in side:
                continue
            (a, copies_a, left), (b, copies_b, right) = parts[0], parts[-1]
            both = shared_members(left, right)
            size = lambda sets: np.array([len(s) for s in sets], np.int64)
            link = 100 * both >= percent * (size(left)[:, None] + size(right) - both)
            if len(parts) == 1:
                link &= a[:, None] != b
            if as_pairs:
                x, y = np.nonzero(np.triu(link) if len(parts) == 1 else link)
                columns = [np.minimum(a[x], b[y]), np.maximum(a[x], b[y])]
            elif len(parts) == 1:
                columns = [a, link @ copies_a]
            else:
                columns = [np.r_[a, b], np.r_[link @ copies_b, copies_a @ link]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b"])

    return run


def _inside(docs: DataFrame, member: DataFrame, threshold: float, shingle: int, as_pairs: bool) -> DataFrame:
    """(a, b): links between class representatives, or per representative the documents linked with it."""
    classes = member.where("rep is not null").groupBy("rep", "component").agg(F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"))
    classes = stored(classes)
    several = classes.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("members")).where("sets > 1")
    reps = stored(classes.join(several, "component").withColumnRenamed("rep", "id"))
    rows = docs.join(sized(reps), "id")
    chunks = F.ceil(F.greatest(F.col("sets") / CHUNK_SETS, F.col("members") / CHUNK_MEMBERS)).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id", "component"), chunks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), -1).otherwise(1)
    rows = rows.select(
        "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "id", "copies", "n", "text"
    )
    dealt = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return stored(dealt.mapInArrow(_linked(threshold, shingle, as_pairs), "a long, b long"), TEXTS)


def _columns(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))


def ngram_joined(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.75, shingle: int = 5) -> DataFrame:
    """One row per document: id, n_shingles, component_id, class_id, n_links.

    As `ngram_classes`, with the class of equal sets (its smallest id) and the number of
    other documents that the document links with, its copies included. A text
    without words has no links and itself as its class; a row with a null id has a
    null class without links unless its set is that of a row with an id.
    """
    docs = _columns(docs, id_column, text_column)
    member = stored(class_members(docs, threshold, shingle))
    found = _inside(docs, member, threshold, shingle, False).groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    copies = member.where("rep is not null").groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    counted = stored(copies.join(found, "rep", "left"))
    links = F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0))
    return member.join(counted, "rep", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce("rep", "id").alias("class_id"), links.cast("long").alias("n_links"),
    )


def ngram_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.75, shingle: int = 5) -> DataFrame:
    """(a, b), a < b: the linked pairs of class representatives; `ngram_joined` tells each document's class."""
    docs = _columns(docs, id_column, text_column)
    return _inside(docs, stored(class_members(docs, threshold, shingle)), threshold, shingle, True)
