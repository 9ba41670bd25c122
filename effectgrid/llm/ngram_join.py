"""N-gram Jaccard join by parity sketches.

A text's set holds its distinct shingles. Every shingle flips one bit of a
sketch, so two sketches differ in at most as many bits as their sets differ in
members. Sets of similarity s differ in at most (1 - s) / (1 + s) of the sum
of their sizes, so that a sketch cut in more blocks than that has equal blocks.

* Size bands. Scheme k serves pairs whose larger set has 64 * 2^(k-1) to
  64 * 2^k - 1 members. A set belongs to the scheme of its own size and to the
  next one if a partner of the largest size that it can link with is there.
* Block sketches. In scheme k the bit space is cut into half as many blocks as
  the band's upper end (one block per bit in the lowest band). A block is
  named by the fingerprint of its odd bits. The first 64 blocks are joined:
  each agrees in a pair at the threshold with a probability over 0.4, so a
  pair is missed with one below 1e-14, and pairs that differ less with far
  smaller ones. Sets below 64 members join all their blocks and miss nothing.
* Verification. All pairs that a join returns are verified on their whole
  shingle sets, recomputed from the texts.

Equal sets are one class before any join. In a run of sets that share a block,
all are first held against the smallest id alone. Whatever links falls into a
component; only runs that still hold several components are compared in full,
in pairs of bounded chunks. Dense sketches, whose Hamming distance is a lower
bound too, discard most pairs before their texts are needed.

A pair that shares several blocks is named in the run of the smallest of them
only, and by a set outside the chunk's most frequent component. A set names its
nearest partners in other components first, since one link is enough to join
it to them: in a first round in its largest runs alone, in a second in all that
are still open. Runs in which a set has more partners to name are compared
again, with more of them, as long as they hold several components. The rounds
end when every pair that the sketches allow has been verified or lies in one
component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effectgrid.llm.components import components
from effectgrid.llm.tables import only, stored
from effectgrid.llm.words import U64, mix, pieces, salt, shingle_sets

LOWEST_BAND = 64
BLOCKS = 64
#: Sets in one of the two chunks that a task compares at a time.
CHUNK = 2048
#: Partners that a set of a run names in the first round; each further round takes 16 times as many.
NEAREST = 8
#: Of a set's open runs, those that the first round compares.
FIRST_RUNS = 2
#: Rows of ids that may be broadcast, about 20 MB; more are joined by a shuffle.
BROADCAST_IDS = 300_000
#: Rows with texts that a task's Python gets at a time.
TEXTS = 500
#: Bits of a dense sketch for each member that a set of the scheme has at most.
PART = 2


def scheme_of(size: int) -> int:
    """0 below 64 members, then one more for every doubling."""
    return max(0, (size // LOWEST_BAND).bit_length())


def block_keys(tokens: np.ndarray, scheme: int) -> np.ndarray:
    """Names of the blocks with tokens, of one set in one scheme."""
    if not len(tokens):
        return tokens
    bits = 20 if scheme == 0 else 5 + scheme
    block = tokens >> U64(64 - bits)
    if scheme:
        tokens, block = tokens[block < BLOCKS], block[block < BLOCKS]
        if not len(tokens):
            return tokens
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    odd = np.bitwise_xor.reduceat(mix(tokens), first)
    with np.errstate(over="ignore"):
        names = mix(odd + mix(block[first] + salt(1000 + scheme)))
    return names & ~U64(63) | U64(scheme)  # the low six bits tell the scheme


def dense_sketch(tokens: np.ndarray, scheme: int) -> bytes:
    """PART bits for each member that a set of the scheme has at most, flipped by its tokens."""
    bits = PART * LOWEST_BAND << scheme
    at = (mix(tokens ^ salt(7)) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()


SKETCH = "id long, n long, digest binary, keys array<long>, bits array<struct<scheme int, sketch binary>>"


def _sketches(threshold: float, shingle: int):
    reach = 1 / threshold
    bits = pa.list_(pa.struct([("scheme", pa.int32()), ("sketch", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1)):
                rows: dict[str, list] = {"n": [], "digest": [], "keys": [], "bits": []}
                for s in shingle_sets(data, offsets, shingle):
                    k = scheme_of(len(s))
                    schemes = [k, k + 1] if scheme_of(int(len(s) * reach + 1e-9)) > k else [k]
                    rows["n"].append(len(s))
                    rows["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    rows["keys"].append(np.concatenate([block_keys(s, x) for x in schemes]).view(np.int64))
                    rows["bits"].append([{"scheme": x, "sketch": dense_sketch(s, x)} for x in schemes])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        pa.array(rows["n"], pa.int64()),
                        pa.array(rows["digest"], pa.binary()),
                        pa.array(rows["keys"], pa.list_(pa.int64())),
                        pa.array(rows["bits"], bits),
                    ],
                    ["id", "n", "digest", "keys", "bits"],
                )

    return run


def _verify(threshold: float, shingle: int):
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[object, np.ndarray | None] = (None, None)
        for batch in batches:
            names = batch.schema.names
            a, b = batch.column(names.index("a")), batch.column(names.index("b"))
            left = batch.column(names.index("text_a"))
            kept, ids = [], a.to_pylist()
            for i, j, data, offsets in pieces(batch.column(names.index("text_b"))):
                for x, right in zip(range(i, j), shingle_sets(data, offsets, shingle)):
                    if known[0] != ids[x]:
                        _, _, data_a, at = next(pieces(left[x : x + 1]))
                        known = (ids[x], shingle_sets(data_a, at, shingle)[0])
                    both = len(np.intersect1d(known[1], right, assume_unique=True))
                    if 100 * both >= percent * (len(known[1]) + len(right) - both):
                        kept.append(x)
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], ["a", "b"])

    return run


def sized(rows: DataFrame) -> DataFrame:
    """Stored rows of ids, to be broadcast if they have been counted to be few."""
    few = rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return F.broadcast(rows) if few else rows


def of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose id is in a pair: wide rows are left out before they are shuffled."""
    return rows.join(sized(pairs.select(F.explode(F.array("a", "b")).alias("id"))), "id", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough."""
    texts = of_pairs(texts, pairs)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_verify(threshold, shingle), "a long, b long")


def _words_of(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length, as rows of 64-bit words."""
    return np.frombuffer(b"".join(sketches), U64).reshape(len(sketches), -1)


def _far(threshold: float):
    """Drops pairs whose sketches differ in more bits than linked sets can."""
    part = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            scheme, most = col["scheme"].to_numpy(), part * (col["n_a"].to_numpy() + col["n_b"].to_numpy()) + 1e-9
            left, right = col["sketch_a"].to_pylist(), col["sketch_b"].to_pylist()
            keep = np.zeros(len(scheme), bool)
            for k in np.unique(scheme):
                for at in np.array_split(np.flatnonzero(scheme == k), max(1, (len(scheme) << int(k)) >> 14)):
                    if len(at):
                        off = np.bitwise_count(_words_of([left[i] for i in at]) ^ _words_of([right[i] for i in at])).sum(axis=1, dtype=np.int64)
                        keep[at] = off <= most[at]
            kept = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([col[c].take(kept) for c in ("a", "b")], ["a", "b"])

    return run


def not_far(pairs: DataFrame, bits: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b, scheme), those (a, b) whose sketches allow a link."""
    side = lambda x: bits.select(F.col("id").alias(x), "scheme", F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    joined = pairs.join(side("a"), ["a", "scheme"]).join(side("b"), ["b", "scheme"])
    size = F.least("n_a", "n_b") + 1e-9 >= threshold * F.greatest("n_a", "n_b")
    return joined.where(size).mapInArrow(_far(threshold), "a long, b long")


def _near(threshold: float, nearest: int):
    """Of sorted chunk pairs, pairs of different components whose sketches allow a link.

    A set names its nearest partners; more tells that it has others. runs are
    the keys of all runs that a set is in, in ascending order.
    """
    part = (1 - threshold) / (1 + threshold)

    def compare(rows: dict, key: int) -> list[np.ndarray] | None:
        ids, n, component, side = (rows[c] for c in ("id", "n", "component", "side"))
        bits, runs = _words_of(rows["sketch"]), rows["runs"]
        values, counts = np.unique(component, return_counts=True)
        most = values[counts.argmax()]
        by_size = {k: np.flatnonzero(side == k) for k in (-1, 0, 1)}
        by_size = {k: v[np.argsort(n[v], kind="stable")] for k, v in by_size.items()}
        sizes = {k: n[v] for k, v in by_size.items()}
        out: list[list] = [[], [], []]
        for x in np.flatnonzero(component != most):
            other = -side[x]
            span = slice(*np.searchsorted(sizes[other], [threshold * n[x] - 1e-6, n[x] / threshold + 1e-6]))
            y = by_size[other][span]
            # of two that both name, the one with the smaller id does
            y = y[(component[y] != component[x]) & ((component[y] == most) | (ids[y] > ids[x]))]
            if not len(y):
                continue
            off = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64)
            close = off <= part * (n[x] + n[y]) + 1e-9
            y, off = y[close], off[close]
            mine = runs[x][: np.searchsorted(runs[x], key)]
            if len(mine) and len(y):  # pairs that share an earlier block are named there
                first = np.array([not np.isin(runs[i][: np.searchsorted(runs[i], key)], mine, assume_unique=True).any() for i in y])
                y, off = y[first], off[first]
            more = len(y) > nearest
            if more:
                y = y[np.argpartition(off, nearest)[:nearest]]
            out[2].append(np.full(len(y), more))
            out[0].append(np.minimum(ids[y], ids[x]))
            out[1].append(np.maximum(ids[y], ids[x]))
        return [np.concatenate(c) for c in out] if out[0] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None  # the chunk pair that is being read: two chunks at most

        def done():
            if not held:
                return
            t = pa.Table.from_batches(held)
            rows = {c: t[c].to_numpy() for c in ("side", "id", "component", "n")} | {"sketch": t["sketch"].to_pylist()}
            lists = t["runs"].combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            rows["runs"] = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
            found = compare(rows, name[0])
            if found is not None and len(found[0]):
                same = [pa.array(np.full(len(found[0]), name[0] & 63, np.int32)), pa.array(np.full(len(found[0]), name[0], np.int64))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, found), *same], ["a", "b", "more", "scheme", "key"])

        for batch in batches:
            at = np.stack([batch.column(batch.schema.names.index(c)).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), at.shape[1]]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j > i and (now := tuple(at[:, i].tolist())) != name:
                    yield from done()
                    held, name = [], now
                if j > i:
                    held.append(batch.slice(i, j - i))
        yield from done()

    return run


def _chunk_pairs(rows: DataFrame) -> DataFrame:
    """Rows of a run (key, n_run, ...), once for each pair of chunks that they are in.

    side -1 and 1 are the two chunks, 0 is one chunk held against itself.
    """
    # a chunk has half of CHUNK rows on average; ids are hashed, so none has much more
    rows = rows.withColumn("chunks", F.ceil(F.col("n_run") * 2 / CHUNK).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id", "key"), "chunks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), -1).otherwise(1)
    return rows.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "side": side})


def class_members(docs: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(id, n, rep, component) of all rows (id, text): the size of the set, the smallest id with an equal set, the component.

    Both are null for a row without shingles and for one with a null id, unless
    a row with an id has the same set.
    """
    sketches = stored(docs.mapInArrow(_sketches(threshold, shingle), SKETCH), TEXTS)
    alike = sketches.where("n > 0 and id is not null")
    classes = stored(alike.groupBy("digest").agg(F.min("id").alias("rep")))
    reps = alike.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    keys = reps.select("id", F.explode("keys").alias("key"))
    runs = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_run"), F.min("id").alias("lead")).where("n_run > 1")
    shared = stored(keys.join(runs, "key").withColumn("scheme", F.col("key").bitwiseAND(63).cast("int")))
    bits = sketches.select("id", "n", F.explode("bits").alias("s")).select("id", "n", "s.*")

    stars = shared.where("id <> lead").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.min("scheme").alias("scheme"))
    stars = stored(stars)
    close = stored(not_far(stars, bits, threshold))
    links = stored(verified(close, docs, threshold, shingle), TEXTS)
    found = stored(components(links))

    # runs of two are settled; of the others, those that still hold several components
    rows, tested, nearest, first = shared.where("n_run > 2"), stars.select("a", "b"), NEAREST, True
    while True:
        named = rows.join(sized(found.withColumnRenamed("node", "id")), "id", "left")
        named = named.withColumn("component", F.coalesce("component", "id"))
        open_runs = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        rest = named.join(open_runs.select("key"), "key", "left_semi")
        if first:
            largest = Window.partitionBy("id").orderBy(F.desc("n_run"), "key")
            rest = rest.withColumn("r", F.row_number().over(largest)).where(F.col("r") <= FIRST_RUNS).drop("r")
        rest = stored(rest)
        # at most all blocks of one set
        lists = rest.groupBy("id", "scheme").agg(F.sort_array(F.collect_list("key")).alias("runs"))
        lists = lists.join(bits.select("id", "scheme", "n", "sketch"), ["id", "scheme"])
        pairs = _chunk_pairs(rest.join(lists, ["id", "scheme"])).select("key", "i", "j", "side", "id", "component", "n", "sketch", "runs")
        pairs = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        near = stored(pairs.mapInArrow(_near(threshold, nearest), "a long, b long, more boolean, scheme int, key long"))
        new = stored(near.select("a", "b").join(sized(tested), ["a", "b"], "left_anti"))
        if not new.isEmpty():
            links = links.union(stored(verified(new, docs, threshold, shingle), TEXTS))
            found = stored(components(links))
            tested = tested.union(new)
        if not first:
            again = near.where("more").select("key").distinct()
            if again.isEmpty():
                break
            rows, nearest = stored(rows.join(again, "key", "left_semi")), nearest * 16
        first = False

    member = sketches.select("id", "n", "digest").join(classes, "digest", "left")
    out = member.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("id", "n", "rep", F.coalesce("component", "rep").alias("component"))


def ngram_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.75, shingle: int = 5) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links).

    docs needs an integer id column without repeats and a text column; other
    columns are not read. Null or empty texts and texts without words have no
    shingles and link with nothing. Texts of equal sets link with each other.
    An empty table gives an empty result. Rows with a null id are kept with a
    null component.
    """
    docs = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    member = class_members(docs, threshold, shingle)
    return member.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.75) -> DataFrame:
    """The documents that are the smallest id of their component; all columns kept.

    Rows of one id stay together if one of them stays. A row with a null id stays
    unless its shingles are those of a row with an id; all such rows stay if one does.
    """
    classes = ngram_classes(only(docs, id_column, text_column), id_column, text_column, threshold)
    stay = classes.where(F.col("component_id").eqNullSafe(F.col(id_column))).select(F.col(id_column).alias("__kept")).distinct()
    return docs.join(stay, F.col(f"`{id_column}`").cast("long").eqNullSafe(F.col("__kept")), "left_semi")
