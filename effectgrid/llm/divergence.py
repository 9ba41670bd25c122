"""Source divergence audit over a vocabulary in minimal acyclic transducers.

Pass 1 counts for each language the documents that hold a term and keeps the terms
of `least` documents. These are sorted by a range shuffle, which gives each its
ordinal, and cut in blocks of bytes; of each block a transducer is built. Pass 2
streams the texts through the transducers of their language and counts ordinals by
source. All that follows works on (language, source, ordinal, count): shares in
whole numbers, the largest terms of a source with ties by ordinal, and the
divergence of each two sources of a language in tiles of sources x ordinals.

Transducers reach the tasks in sets of at most `model_bytes`; a larger vocabulary
takes another pass over the texts of its languages for each set.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectgrid.llm import transducer
from effectgrid.llm.tables import stored
from effectgrid.llm.words import LOWER, pieces

#: Documents of a language that a kept term occurs in, at least; ranks of the term part. Fixed by the task.
LEAST_DOCS = 10
TOP = 10
#: Shares are parts of this. Fixed by the task.
WHOLE = 1_000_000_000
#: Bytes of terms in a transducer (one term may be longer), and of the transducers of a pass.
BLOCK_BYTES = 1 << 20
MODEL_BYTES = 64 << 20
#: Terms that a range of the sort holds, about.
RANGE_TERMS = 1 << 18
#: Entries that a task holds before it passes them on.
HELD = 1 << 18
#: Sources and ordinals of a tile.
TILE_SOURCES = 64
TILE_TERMS = 8192

#: Words are [^\x00-\x40\x5B-\x60\x7B-\x7F]+ with A-Z lower-cased: all else becomes a blank.
TABLE = bytes(int(LOWER[b]) if 65 <= b < 91 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
_TABLE = np.frombuffer(TABLE, np.uint8)


def _rows(docs: DataFrame, text_column: str, lang_column: str, source_column: str) -> DataFrame:
    own = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return docs.select(own(lang_column).alias("lang"), own(source_column).alias("source"), own(text_column).alias("text"))


def document_counts(rows: DataFrame) -> DataFrame:
    """(lang, term, docs): documents of the language that hold the term; counted in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def put():
            for lang, found in held.items():
                if found:
                    terms = [t.decode() for t in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(terms)), pa.array(terms), pa.array(list(found.values()), pa.int64())], ["lang", "term", "docs"]
                    )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = held.setdefault(lang, Counter())
                found.update(set(text.as_buffer().to_pybytes().translate(TABLE).split()))
                if sum(map(len, held.values())) > HELD:
                    yield from put()
        yield from put()

    return rows.select("lang", "text").mapInArrow(count, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(rows: DataFrame, least: int = LEAST_DOCS, block_bytes: int = BLOCK_BYTES, range_terms: int = RANGE_TERMS) -> DataFrame:
    """(lang, term, ordinal, block): the kept terms; ordinals from 0 in byte order, blocks of about block_bytes."""
    kept = stored(document_counts(rows).where(F.col("docs") >= least).select("lang", "term"))
    ranges = max(1, -(-kept.count() // range_terms))
    # written once, so that the ranges do not move
    parts = stored(kept.repartitionByRange(ranges, "lang", "term").withColumn("part", F.spark_partition_id()))
    parts = parts.withColumn("bytes", F.octet_length("term") + 1)
    sums = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = sums.select(
        "lang", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b")
    )
    inside = Window.partitionBy("lang", "part").orderBy("term")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("place", F.row_number().over(inside) - 1).withColumn("upto", F.coalesce(F.sum("bytes").over(upto), F.lit(0)))
    placed = placed.join(sums, ["lang", "part"])
    ordinal, block = F.col("n") + F.col("place"), F.floor((F.col("b") + F.col("upto")) / block_bytes)
    return stored(placed.select("lang", "term", ordinal.cast("long").alias("ordinal"), block.cast("long").alias("block")))


def transducers(kept: DataFrame) -> DataFrame:
    """(lang, block, first, terms, model): the transducer of each block of the vocabulary."""

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal")
        model = transducer.build(t.encode() for t in frame["term"])
        one = frame.iloc[0]
        return pd.DataFrame([(one["lang"], one["block"], one["ordinal"], len(frame), model.packed())], columns=["lang", "block", "first", "terms", "model"])

    schema = "lang string, block long, first long, terms long, model binary"
    return stored(kept.groupBy("lang", "block").applyInPandas(built, schema))


def _streamed(rows: DataFrame, models: list) -> DataFrame:
    """(lang, source, ordinal, count) of the terms of these transducers, summed by task in part."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast([(m["lang"], m["first"], bytes(m["model"])) for m in models])  # at most MODEL_BYTES and one more

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list] = {}
        for lang, first, packed in shared.value:
            by_lang.setdefault(lang, []).append((first, transducer.Transducer.unpacked(packed)))
        groups: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed():
            group, ordinal, count = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((ordinal, group))
            group, ordinal, count = group[order], ordinal[order], count[order]
            new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (ordinal[1:] != ordinal[:-1])])
            return group[new], ordinal[new], np.add.reduceat(count, new)

        def put():
            if held:
                group, ordinal, count = summed()
                names = list(groups)
                langs, sources = (pa.array([n[i] for n in names]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), pa.array(ordinal), pa.array(count)], ["lang", "source", "ordinal", "count"])
            held.clear()
            groups.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j, data, offsets in pieces(batch.column(2)):
                low = _TABLE[data]
                letter = np.zeros(len(low) + 2, bool)
                letter[1:-1] = low != 32
                cut = np.zeros(len(low) + 1, bool)
                cut[offsets] = True
                start = np.flatnonzero(letter[1:] & (~letter[:-1] | cut))
                end = np.flatnonzero(letter[:-1] & (~letter[1:] | cut))
                bounds = np.searchsorted(start, offsets)
                of = np.repeat([groups.setdefault(key, len(groups)) for key in zip(langs[i:j], sources[i:j])], np.diff(bounds))
                spoken = np.repeat(np.array([langs[k] for k in range(i, j)], object), np.diff(bounds))
                for lang in set(langs[i:j]) & set(by_lang):
                    mine = np.flatnonzero(spoken == lang)
                    for first, model in by_lang[lang]:
                        place = model.ordinals(low, start[mine], end[mine])
                        hit = place >= 0
                        if hit.any():
                            held.append((of[mine][hit], place[hit] + first, np.ones(int(hit.sum()), np.int64)))
                if sum(len(h[0]) for h in held) > 4 * HELD:
                    held[:] = [summed()]
                    if len(held[0][0]) > HELD:
                        yield from put()
        yield from put()

    return rows.mapInArrow(stream, "lang string, source string, ordinal long, count long")


def term_counts(rows: DataFrame, models: DataFrame, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """(lang, source, ordinal, count > 0): the texts streamed through the transducers, a set of these at a time."""
    sizes = models.select("lang", "block", F.octet_length("model").cast("long").alias("size"))
    # a row for each transducer, some thousand terms each
    before = Window.orderBy("lang", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.withColumn("set", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / model_bytes).cast("long")))
    out = None
    for number in [r["set"] for r in sizes.select("set").distinct().orderBy("set").collect()]:
        own = models.join(sizes.where(F.col("set") == number).select("lang", "block"), ["lang", "block"])
        found = _streamed(rows, own.orderBy("lang", "first").collect())  # model_bytes and one more at most
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "lang string, source string, ordinal long, count long")
    return stored(out.groupBy("lang", "source", "ordinal").agg(F.sum("count").alias("count")))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (N + 2 V)), in whole numbers; null if V is 0."""
    wide = F.lit(WHOLE).cast("decimal(20,0)") * (count + 2).cast("decimal(18,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", wide, (total + 2 * kept).cast("decimal(20,0)"))).cast("long")


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def _pair_sums(shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums over all ordinals of f, for each two sources of a language.

    shares: (lang, source, ordinal, p), with a row of ordinal -1 and the share of an
    absent term for each source and run of TILE_TERMS ordinals, `run`.
    """
    sources = shares.where("ordinal = -1 and run = 0").select("lang", "source")
    tiles = sources.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE_SOURCES).cast("int").alias("tiles"))
    rows = shares.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    # a row goes to every pair of tiles that its own is in
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.withColumn("other", other)
    rows = rows.withColumns({"one": F.least("tile", "other"), "two": F.greatest("tile", "other")})

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        lang, run = frame["lang"].iloc[0], int(frame["run"].iloc[0])
        one, two = int(frame["one"].iloc[0]), int(frame["two"].iloc[0])
        base = frame[frame["ordinal"] == -1]
        width = int(base["width"].iloc[0])
        sides = []
        for tile in (one, two):
            mine = base[base["tile"] == tile]
            names = {s: i for i, s in enumerate(mine["source"])}
            p = np.repeat(mine["p"].to_numpy(np.int64)[:, None], width, axis=1)
            own = frame[(frame["tile"] == tile) & (frame["ordinal"] >= 0)]
            p[own["source"].map(names).to_numpy(int), own["ordinal"].to_numpy(int) - run * TILE_TERMS] = own["p"].to_numpy(np.int64)
            sides.append((list(names), p))
        (left, p), (right, q) = sides
        out = []
        for i, a in enumerate(left):
            f = _apart(p[i][None, :], q).sum(axis=1)
            out += [(lang, a, b, int(v)) for b, v in zip(right, f) if (a < b if one == two else True)]
        return pd.DataFrame(out, columns=["lang", "a", "b", "value"])

    parts = rows.groupBy("lang", "run", "one", "two").applyInPandas(sums, "lang string, a string, b string, value long")
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s")).select("lang", "s.source", "s.item", "value")


def divergence(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
    least: int = LEAST_DOCS, top: int = TOP, block_bytes: int = BLOCK_BYTES, model_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language are apart.

    part `pair`: a row for each other source of the language, part `term`: the
    first `top` terms that are more frequent in the source than in the language.
    Null text, language or source is ''. A source whose texts have no kept term has
    its pairs but no terms; a language with one source has no pairs; in a language
    without kept terms all pairs have value 0. Repeated rows count each. An empty
    table gives an empty result; other columns are not read. The pairs of a
    language grow with the square of its sources, as the result asks.
    """
    rows = _rows(docs, text_column, lang_column, source_column)
    kept = vocabulary(rows, least, block_bytes)
    counts = term_counts(rows, transducers(kept), model_bytes)
    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).drop("docs")
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "kept"])
    groups = stored(groups)

    # terms: a source's share against the language's
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("total"), F.col("kept")))
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("count").alias("all"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.max("kept").alias("all_kept"))
    whole = whole.join(langs, "lang").select("lang", "ordinal", _share(F.col("all"), F.col("all_total"), F.col("all_kept")).alias("q"))
    shares = stored(shares.select("lang", "source", "ordinal", "p"))
    over = shares.join(whole, ["lang", "ordinal"]).where("p > q")
    over = over.withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    terms = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    terms = terms.join(kept.select("lang", "ordinal", "term"), ["lang", "ordinal"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # pairs: tiles of sources and ordinals; every source is in every run of ordinals
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("kept") / TILE_TERMS) - 1).cast("long")))
    base = groups.withColumn("run", runs)
    width = F.least(F.lit(TILE_TERMS), F.col("kept") - F.col("run") * TILE_TERMS).cast("long")
    absent = F.coalesce(_share(F.lit(0).cast("long"), F.col("total"), F.col("kept")), F.lit(0))
    base = base.select("lang", "source", F.lit(-1).cast("long").alias("ordinal"), absent.alias("p"), "run", width.alias("width"))
    present = shares.select("lang", "source", "ordinal", "p", F.floor(F.col("ordinal") / TILE_TERMS).cast("long").alias("run"), F.lit(0).cast("long").alias("width"))
    pairs = _pair_sums(base.unionByName(present))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # UTF-8 order
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms)
