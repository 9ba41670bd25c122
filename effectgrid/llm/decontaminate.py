"""Benchmark decontamination by suffix arrays of the training texts.

The texts of a task are cut into shards of whole texts and bounded size. A
shard's words, as 64-bit hashes, get a suffix array, sorted by prefix doubling
to WINDOW words or more. Every suffix of every benchmark item is looked up by
binary search; its neighbours there give the longest verbatim match, and the
range of suffixes that begin with its first 13 words gives every place.

The benchmark is a stated query set: it is held against all shards in blocks of
bounded size, each of which fits a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectgrid.llm.tables import only, stored
from effectgrid.llm.words import ALNUM_CUT, U64, Words, pieces

WINDOW = 13
SHARD_BYTES = 1 << 22
#: Bytes of benchmark text in one block, more only if one item has more.
BLOCK_BYTES = 1 << 22
#: Blocks that a pass over the texts searches.
PASS_BLOCKS = 8
#: No word hashes to these: text ends, and the end of the pattern table.
_END = U64(2**64 - 1)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes, sorted by their first `depth` tokens at least (as unsigned numbers)."""
    n = len(tokens)
    order = np.argsort(tokens)
    rank = np.zeros(n, np.int64)
    rank[order] = np.cumsum(np.r_[False, tokens[order][1:] != tokens[order][:-1]]) if n else 0
    span = 1
    while span < depth and n and rank.max() < n - 1:
        later = np.zeros(n, np.int64)
        later[:-span or None] = rank[span:] + 1 if span < n else 0
        key = rank * (n + 1) + later
        order = np.argsort(key)
        rank[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
        span *= 2
    return order


def _below(tokens: np.ndarray, at: np.ndarray, words: np.ndarray, start: np.ndarray, length: np.ndarray, or_equal: bool) -> np.ndarray:
    """Whether the suffixes at `at` sort before the patterns (or begin with them)."""
    open_, less = np.ones(len(at), bool), np.zeros(len(at), bool)
    n = len(tokens)
    for k in range(int(length.max(initial=0))):
        live = np.flatnonzero(open_ & (k < length))
        if not len(live):
            break
        i = at[live] + k
        inside = i < n
        x, y = tokens[np.minimum(i, n - 1)], words[start[live] + k]
        lower = ~inside | (x < y)
        less[live[lower]] = True
        open_[live[lower | (x > y)]] = False
    return less | (open_ & or_equal)


def search(tokens: np.ndarray, array: np.ndarray, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern words[start : start + length] the range of the suffix array that begins with it."""
    out = []
    for or_equal in (False, True):
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(array), np.int64)
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) // 2
            below = _below(tokens, array[mid], words, start[live], length[live], or_equal)
            low[live[below]] = mid[below] + 1
            high[live[~below]] = mid[~below]
        out.append(low)
    return out[0], out[1]


def extend(tokens: np.ndarray, at: np.ndarray, words: np.ndarray, start: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many words suffixes and patterns have in common, up to each pattern's room."""
    common, live = np.zeros(len(at), np.int64), np.flatnonzero((at >= 0) & (at < len(tokens)) & (room > 0))
    while len(live):
        i = at[live] + common[live]
        live = live[(i < len(tokens)) & (common[live] < room[live])]
        live = live[tokens[at[live] + common[live]] == words[start[live] + common[live]]]
        common[live] += 1
    return common


class Block:
    """Word hashes of some benchmark items, with the patterns that are searched."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        texts = [(i, *p) for i, t in items for p in [next(pieces(pa.array([t or ""])))[2:]]]
        parts = [Words(data, offsets, ALNUM_CUT).hash for _, data, offsets in texts]
        self.items = [i for i, _, _ in texts]
        size = np.array([len(p) for p in parts], np.int64)
        begin = np.r_[0, np.cumsum(size)]
        self.words = np.concatenate([*parts, np.zeros(0, U64)])
        self.item = np.repeat(np.arange(len(size)), size)
        self.at = np.arange(len(self.words)) - begin[self.item]  # word of the item
        self.room = size[self.item] - self.at  # words from there to the item's end
        whole = (self.at == 0) & (size[self.item] < window)
        self.window = np.where(self.room >= window, window, np.where(whole, self.room, 0))


def shard_matches(tokens: np.ndarray, array: np.ndarray, block: Block, window: int):
    """Every place of every window: pattern, token position, words in common from there.

    Also for each item suffix its longest match in the shard (length, position).
    """
    every = np.arange(len(block.words))
    seek = np.where(block.window > 0, block.window, np.minimum(block.room, window))
    low, high = search(tokens, array, block.words, every, seek)
    near = np.stack([np.clip(low - 1, 0, len(array) - 1), np.clip(low, 0, len(array) - 1)])
    lengths = np.stack([extend(tokens, array[x], block.words, every, block.room) for x in near])
    best = lengths.argmax(axis=0)
    longest = lengths[best, every], array[near[best, every]]
    n = np.where(block.window > 0, high - low, 0)
    pattern = np.repeat(every, n)
    step = np.arange(len(pattern)) - np.repeat(np.cumsum(n) - n, n)
    place = array[low[pattern] + step]
    common = extend(tokens, place, block.words, pattern, block.room[pattern])
    # suffixes that agree beyond the sorted depth are told apart by their own extension
    if len(pattern):
        order = np.lexsort((place, -common, pattern))
        first = order[np.r_[True, pattern[order][1:] != pattern[order][:-1]]]
        better = common[first] > longest[0][pattern[first]]
        longest[0][pattern[first[better]]], longest[1][pattern[first[better]]] = common[first[better]], place[first[better]]
    return (pattern, place, common), longest


def _spans(pattern, place, doc, block: Block):
    """Per document and item, the merged token ranges that windows cover."""
    item = block.item[pattern]
    order = np.lexsort((place, item, doc))
    doc, item, place, end = doc[order], item[order], place[order], (place + block.window[pattern])[order]
    if not len(doc):
        return doc, item, place, end
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]
    # running maximum of ends within each (doc, item): groups are kept apart by an offset
    group = np.cumsum(new) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    cut = new | np.r_[True, place[1:] > reach[:-1]]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:] - 1, len(doc) - 1]
    return doc[first], item[first], place[first], reach[last]


def _shards(batches: Iterator[pa.RecordBatch]):
    """Whole texts, up to SHARD_BYTES together: ids, tokens with an end after each text, begins, word counts."""
    for batch in batches:
        for i, j, data, offsets in pieces(batch.column("text"), SHARD_BYTES):
            w = Words(data, offsets, ALNUM_CUT)
            counts = np.diff(w.first)
            tokens = np.full(len(w.hash) + len(counts), _END, U64)
            tokens[np.arange(len(w.hash)) + np.repeat(np.arange(len(counts)), counts)] = np.minimum(w.hash, _END - U64(1))
            begin = w.first[:-1] + np.arange(len(counts))
            yield batch.slice(i, j - i).select(["row", "id"]), tokens, begin, counts


def _match(held: list[Block], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, begin, counts in _shards(batches):
            spans: list[list] = [[] for _ in range(ids.num_rows)]
            longest: list[list] = [[] for _ in range(ids.num_rows)]
            # one suffix array of the shard, searched for every block
            array = suffix_array(tokens, window) if counts.any() else None
            for block in held if counts.any() else []:
                if not len(block.words):
                    continue
                (pattern, place, _), (length, where) = shard_matches(tokens, array, block, window)
                doc = np.searchsorted(begin, place, "right") - 1
                for d, item, a, b in zip(*_spans(pattern, place, doc, block)):
                    spans[d].append({"item": block.items[item], "first": int(a - begin[d]), "end": int(b - begin[d])})
                for p in np.flatnonzero((length >= np.maximum(block.window, 1)) & (block.window > 0)):
                    # a suffix inside the match of the suffix before it is no match of its own
                    if block.at[p] and length[p - 1] == length[p] + 1 and where[p - 1] == where[p] - 1 and block.window[p - 1]:
                        continue
                    d = int(np.searchsorted(begin, where[p], "right") - 1)
                    longest[d].append({"item": block.items[block.item[p]], "item_at": int(block.at[p]), "at": int(where[p] - begin[d]), "length": int(length[p])})
            kind = pa.list_(pa.struct([("item", pa.int64()), ("first", pa.int64()), ("end", pa.int64())]))
            kind_long = pa.list_(pa.struct([("item", pa.int64()), ("item_at", pa.int64()), ("at", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*ids.columns, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(longest, kind_long)],
                ["row", "id", "n_words", "spans", "longest"],
            )

    return run


SPANS = "row long, id long, n_words long, spans array<struct<item long, first long, end long>>, longest array<struct<item long, item_at long, at long, length long>>"


def blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[Block]:
    """The items in blocks of bounded size, one at a time; those without an id are one item."""
    held, size = [], 0
    for row in benchmark.orderBy("id", "text").toLocalIterator():
        held.append((row.id, row.text))
        size += len(row.text or "")
        if size >= most:
            yield Block(held, window)
            held, size = [], 0
    if held:
        yield Block(held, window)


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS
) -> DataFrame:
    """(row, id, n_words, spans, longest) of each row of documents, from frames (id, text).

    spans: for each item, the word ranges covered by its windows. longest: the
    longest verbatim match of each item suffix in a shard, with its place. A pass
    over the texts searches pass_blocks blocks; a larger benchmark takes several,
    whose findings meet again by the number of the row, whatever its id.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    found, several, every = None, False, blocks(benchmark, window, block_bytes)
    while held := list(itertools.islice(every, pass_blocks)):
        if found is None and len(held) == pass_blocks:
            rows = stored(rows)  # the numbers must not change from pass to pass
        shared = spark.sparkContext.broadcast(held)  # at most pass_blocks times block_bytes and an item of text each
        part = rows.mapInArrow(lambda it, h=shared: _match(h.value, window)(it), SPANS)
        found, several = (part, False) if found is None else (found.unionAll(part), True)
    if found is None:
        return rows.mapInArrow(_match([], window), SPANS)
    if not several:
        return found
    return found.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.flatten(F.collect_list("longest")).alias("longest"),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    pass_blocks: int = PASS_BLOCKS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match.

    A word is hit inside any occurrence of a window (13 consecutive item words,
    or an item of fewer). Contaminated: at least one hit, and hits are a
    20th of all words or more. Null and empty texts have no words; items without words match
    nothing; no benchmark leaves all documents clean. Rows with repeated or null
    ids are judged one by one. Items without an id match too, and count as one item
    that items_sha256 does not name. Other columns are not read.
    """
    docs = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    items = benchmark.select(F.col(f"`{item_column}`").cast("long").alias("id"), F.col(f"`{item_text_column}`").alias("text"))
    found = matches(docs, items, window, block_bytes, pass_blocks)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end"))))
    covered = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach")),
        lambda acc, s: F.struct(
            (acc["hit"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["first"], acc["reach"]))).alias("hit"),
            F.greatest(acc["reach"], s["end"]).alias("reach"),
        ),
        lambda acc: acc["hit"],
    )
    named = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"].cast("string"))))
    out = found.select("id", "n_words", covered.alias("n_hit"), named.alias("items"), "longest")
    return out.select(
        F.col("id").alias(id_column),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("longest", lambda m: m["length"])), F.lit(0)).alias("longest_match"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    Of rows with one id all go if one is contaminated; rows with a null id likewise
    are one document. Ids without repeats lose only their own rows.
    """
    hit = contamination(only(docs, id_column, text_column), benchmark, id_column, text_column).where("contaminated")
    gone = hit.select(F.col(id_column).alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{id_column}`").cast("long").eqNullSafe(F.col("__gone")), "left_anti")
