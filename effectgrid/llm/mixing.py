"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source has a target number of words. Its documents are dealt into blocks
by a hash. A source's quota is the number of block draws that meet its target:
whole passes over all its blocks, then the first blocks of one more pass, the
last of them in part. What is missing after whole passes is filled by taking, in
the order of passes, blocks and hashes, each document that still fits; a long one
that does not fit is left out and shuts out none after it. At the end the
document that comes nearest to the rest is added if that lessens the miss.
Documents that fill the rest behind the last block drawn ride with a drawn block
of their source. The quotas are split among output shards by a binary
tree: a node's left child draws as many blocks as its shards are to hold,
without replacement, from the node's blocks of all sources, so the number that
each source gives is multivariate hypergeometric and the quotas stay exact. A
leaf's share of a source is the next stretch of the source's permuted blocks,
so draws are disjoint, and its documents are ordered by a hash of their own.

DataFrame and SQL functions only. All random choices are hashes of ids, so
reruns agree. Tables of sources have one row per source; all else is
distributed by source and block, so a source with a third of all rows is no
single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectgrid.llm.tables import only, stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Words of a block and of an output shard, about.
BLOCK_WORDS = 50_000
SHARD_WORDS = 2_000_000
#: Blocks whose prefix sums one task forms.
GROUP = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts; 32 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / 2.0**32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) with weight and target.

    Sources by code point, null last, take the weights in turn and share all
    words by weight. A target stops at `most` times its source's size; what is
    over is shared again by weight among the others until none is above.
    """
    # code points and UTF-8 bytes sort alike; one row per source
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double")
    table = sizes.withColumn("weight", weight).withColumn("limit", (most * F.col("source_size")).cast("double"))
    # sources reach their limits in the order of limit / weight: the level L at which all words are
    # shared has sum(min(limit, L * weight)) = total, so those with limit / weight <= L stop there
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    table = table.withColumns(
        {
            "ratio": F.col("limit") / F.col("weight"),
            "total": F.sum("source_size").over(whole).cast("double"),
            "weights": F.sum("weight").over(whole),
            "stopped": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # the level if exactly the sources before this one are stopped
    table = table.withColumn("level", (F.col("total") - F.col("stopped")) / (F.col("weights") - F.col("gone")))
    # ... and the first source in that order that is not stopped by it tells the level
    table = table.withColumn("open", F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "source", "level")))
    level = F.min("open").over(whole)["level"]
    target = F.when(level.isNull() | (F.col("ratio") <= level), F.col("limit")).otherwise(level * F.col("weight"))
    return table.withColumn("target", target).select("source", "source_size", "weight", "target")


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among `draws` of `total` without replacement, by its inverse distribution at u.

    Weights are relative to the mode's and run over 12 standard deviations on
    either side; what lies beyond is below 1e-30.
    """
    least = F.greatest(F.lit(0).cast("long"), draws + good - total)
    most = F.least(draws, good)
    share = F.when(total > 0, good / total).otherwise(F.lit(0.0))
    mean = draws * share
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - share) * F.when(total > 1, (total - draws) / (total - 1)).otherwise(0.0)))
    low = F.greatest(least, F.floor(mean - 12 * sd).cast("long") - 1)
    high = F.least(most, F.ceil(mean + 12 * sd).cast("long") + 1)
    # ln w(k + 1) - ln w(k), summed from the lower end; weights are scaled by the largest
    real = lambda x: x.cast("double")
    step = lambda k: F.log(real((good - k) * (draws - k))) - F.log(real((k + 1) * (total - good - draws + k + 1)))
    ks = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))

    def add(acc, k):
        last = acc["last"] + step(k)
        top = F.greatest(acc["top"], last)
        return F.struct(last.alias("last"), top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(last - top)).alias("sum"))

    def seek(acc, k):
        last = acc["last"] + step(k)
        passed = acc["passed"] + F.when(acc["upto"] <= acc["goal"], 1).otherwise(0)
        return F.struct(last.alias("last"), acc["top"].alias("top"), acc["goal"].alias("goal"), (acc["upto"] + F.exp(last - acc["top"])).alias("upto"), passed.cast("long").alias("passed"))

    zero = F.lit(0.0)
    begin = F.aggregate(
        ks,
        F.struct(zero.alias("last"), zero.alias("top"), F.lit(1.0).alias("sum")),
        add,
        lambda acc: F.struct(zero.alias("last"), acc["top"].alias("top"), (u * acc["sum"]).alias("goal"), F.exp(-acc["top"]).alias("upto"), F.lit(0).cast("long").alias("passed")),
    )
    return F.aggregate(ks, begin, seek, lambda acc: F.least(low + acc["passed"], high))


def split(quotas: DataFrame, shards: int) -> DataFrame:
    """(source, shard, n) from (source, quota): exact quotas, split by the tree.

    A node holds its shards' range and an array of (source, n); the left child
    draws from the sources one after the other, each conditional on those before.
    """
    entry = F.struct("source", F.col("quota").alias("n"))
    nodes = quotas.where("quota > 0").agg(F.array_sort(F.collect_list(entry)).alias("held"))  # one row per source
    nodes = nodes.select(F.lit(0).alias("first"), F.lit(shards).alias("width"), "held")
    depth = max(0, (shards - 1).bit_length())
    for _ in range(depth):
        total = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        half = F.floor(F.col("width") / 2).cast("int")
        start = F.struct(
            F.array().cast("array<struct<n:bigint>>").alias("out"),
            F.col("total").alias("left"),
            F.col("wanted").alias("wanted"),
        )

        def draw(acc, x):
            u = unit(F.lit("split"), F.col("width"), F.col("first"), x["source"])
            n = hypergeometric(acc["left"], x["n"], acc["wanted"], u)
            return F.struct(
                F.concat(acc["out"], F.array(F.struct(n.alias("n")))).alias("out"),
                (acc["left"] - x["n"]).alias("left"),
                (acc["wanted"] - n).alias("wanted"),
            )

        nodes = nodes.withColumn("total", total).withColumn("half", half)
        nodes = nodes.withColumn("wanted", F.floor(F.col("total") * F.col("half") / F.col("width")).cast("long"))
        nodes = nodes.withColumn("drawn", F.aggregate("held", start, draw, lambda acc: acc["out"]))
        left = F.zip_with("held", "drawn", lambda h, d: F.struct(h["source"].alias("source"), d["n"].alias("n")))
        right = F.zip_with("held", "drawn", lambda h, d: F.struct(h["source"].alias("source"), (h["n"] - d["n"]).alias("n")))
        some = lambda a: F.filter(a, lambda x: x["n"] > 0)
        children = F.array(
            F.struct("first", F.col("half").alias("width"), some(left).alias("held")),
            F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("width") - F.col("half")).alias("width"), some(right).alias("held")),
        )
        nodes = nodes.select(F.explode(F.when(F.col("width") > 1, children).otherwise(F.array(F.struct("first", "width", "held")))).alias("c")).select("c.*")
        nodes = stored(nodes.where("width > 0"))
    return nodes.select(F.col("first").alias("shard"), F.explode("held").alias("h")).select("h.source", "shard", "h.n")


def before_tickets(amounts: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (keys, ticket, amount), one per ticket: (keys, ticket, before), the amounts of the tickets before.

    Prefix sums run over groups of tickets, then inside a group.
    """
    amounts = amounts.withColumn("group", F.floor(F.col("ticket") / GROUP))
    groups = amounts.groupBy(*keys, "group").agg(F.sum("amount").alias("amount"))
    ahead = Window.partitionBy(*keys).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*keys, "group", F.coalesce(F.sum("amount").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy(*keys, "group").orderBy("ticket").rowsBetween(Window.unboundedPreceding, -1)
    return amounts.join(groups, [*keys, "group"]).select(
        *keys, "ticket", (F.col("base") + F.coalesce(F.sum("amount").over(within), F.lit(0))).alias("before")
    )


def first_that_fit(rows: DataFrame) -> DataFrame:
    """Rows (key, ticket, id, size, u, gap) with `in`: those of the first tickets, in order, as long as all fit.

    Prefix sums run over tickets, then inside the ticket, so no task holds a key.
    """
    before = before_tickets(rows.groupBy("key", "ticket").agg(F.sum("size").alias("amount")), ["key"])
    upto = Window.partitionBy("key", "ticket").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(before, ["key", "ticket"]).withColumn("in", F.col("before") + F.sum("size").over(upto) <= F.col("gap"))


def within_reach(rows: DataFrame) -> DataFrame:
    """Of rows (key, ticket, id, size, u, gap) those that may still be taken: of each size the first gap / size.

    What is missing only falls, so of a size the first ones are taken, and no
    more of them than it holds. For a key this leaves at most the sum of
    gap / size over the sizes up to the gap, about gap * ln(gap) rows, however many
    it has. Ranks run inside a ticket, counts over tickets.
    """
    most = F.expr("gap div size")
    own = Window.partitionBy("key", "size", "ticket").orderBy("u", "id")
    near = rows.where("size <= gap").withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most)
    counted = near.groupBy("key", "size", "ticket").agg(F.count(F.lit(1)).alias("amount"))
    before = before_tickets(counted, ["key", "size"]).withColumnRenamed("before", "ahead")
    return near.join(before, ["key", "size", "ticket"]).where(F.col("ahead") + F.col("nth") <= most).drop("nth", "ahead")


def fill(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, id, size, u, block, blocks, passes, part): draws (key, id, block, pass) of the part, and (key, more).

    Each source goes through its documents pass after pass, in the order of
    block, u and id, and takes each that still fits. A round takes the first
    ones up to one that does not fit; what is then missing is less than that
    one's size, so the sizes that count shrink with every round. The rounds after
    the first get only the rows within reach, whose number hangs on what is
    missing and not on the source. more: the tickets reached by the first round.
    """
    room = F.floor(F.col("part") + 1e-6).cast("long")
    rows = docs.where(F.col("passes") < MOST_COPIES).withColumn("gap", room).drop("part")
    copies = rows.select("*", F.explode(F.sequence("passes", F.lit(MOST_COPIES - 1))).alias("pass"))
    ticket = F.col("pass") * F.col("blocks") + F.col("block")
    open_rows, taken, more = copies.withColumn("ticket", ticket), [], None
    while True:
        marked = stored(first_that_fit(open_rows.where("size <= gap")).drop("before"))
        found = marked.where("in")
        if found.isEmpty():
            break
        taken.append(found.select("key", "id", "block", "pass", "size"))
        if more is None:
            more = found.groupBy("key").agg((F.max("ticket") - F.max(F.col("passes") * F.col("blocks")) + 1).alias("more"))
        # one row per source, written so that its size is known before the join is planned
        used = stored(found.groupBy("key").agg(F.sum("size").alias("used")))
        left = marked.where("not in").drop("in").join(used, "key", "left")
        open_rows = left.withColumn("gap", F.col("gap") - F.coalesce("used", F.lit(0))).drop("used")
        if len(taken) == 1:
            open_rows = within_reach(open_rows)
    draws = marked.select("key", "id", "block", "pass", "size").limit(0)
    for part in taken:
        draws = draws.unionByName(part)
    draws = stored(draws)
    if more is None:
        more = draws.groupBy("key").agg(F.count(F.lit(1)).alias("more"))
    # the document, not yet used for this, that comes nearest to what is still missing
    used = stored(draws.groupBy("key").agg(F.sum("size").alias("used")))
    gap = F.col("gap") - F.coalesce("used", F.lit(0))
    rest = rows.join(used, "key", "left").withColumn("gap", gap).withColumn("off", F.abs(F.col("size") - F.col("gap"))).where("off < gap")
    rest = rest.join(draws.select("id"), "id", "left_anti")
    near = rest.groupBy("key").agg(F.min(F.struct("off", "u", "id", "block", "passes")).alias("x")).select("key", "x.id", "x.block", "x.passes")
    return draws.drop("size").union(near), stored(more)


def plan_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Of frames (id, source, size): documents with targets and blocks, and the draws (id, pass, shard, place).

    A document may be drawn once in each of at most MOST_COPIES passes.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes)
    # whole passes, and words that one more pass takes
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("int")
    targets = targets.withColumn("passes", passes).withColumn("part", F.greatest(F.lit(0.0), F.col("target") - passes * F.col("source_size")))
    targets = stored(targets.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / block_words))))
    docs = docs.join(targets, docs["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    docs = docs.withColumn("u", unit(F.lit("block"), F.col("id")))
    docs = docs.withColumn("block", F.floor(F.col("u") * F.col("blocks")).cast("long"))
    docs = stored(docs)

    # no name of a source is that of the null source
    key = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), "source"))
    keyed = targets.select(key.alias("key"), "passes", "part", "blocks")
    filled, more = fill(docs.where("size > 0 and id is not null").select(key.alias("key"), "id", "size", "u", "block", "blocks", "passes", "part"))

    # draws: a source's tickets are its blocks in hashed order, pass after pass
    quota = F.greatest(F.col("passes") * F.col("blocks") + F.coalesce("more", F.lit(0)), F.lit(1)).cast("long")
    quotas = stored(keyed.join(more, "key", "left").select(F.col("key").alias("source"), quota.alias("quota"), "blocks", "passes"))
    words = docs.agg(F.sum("size").alias("n")).first()["n"] or 0
    shards = max(1, -(-words // shard_words))
    leaves = split(quotas.select("source", "quota"), shards)
    order = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("low", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long")))
    tickets = leaves.select("source", "shard", F.explode(F.sequence("low", F.col("low") + F.col("n") - 1)).alias("ticket"))
    tickets = tickets.withColumnRenamed("source", "key")
    # whole passes give all documents of a ticket's block, the fill gives single ones
    quotas = quotas.withColumnRenamed("source", "key")
    whole = docs.where("size > 0 and passes > 0").select(key.alias("key"), "id", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    whole = whole.select("key", "id", "pass", (F.col("pass") * F.col("blocks") + F.col("block")).alias("ticket"))
    own = F.col("pass") * F.col("blocks") + F.col("block")
    ride = F.floor(unit(F.lit("ride"), F.col("pass"), F.col("id")) * F.col("quota")).cast("long")
    single = filled.join(quotas, "key").select("key", "id", "pass", F.when(own < F.col("quota"), own).otherwise(ride).alias("ticket"))
    rows = whole.unionByName(single).join(tickets, ["key", "ticket"])
    place = unit(F.lit("place"), F.col("pass"), F.col("id"))
    draws = rows.select("id", "pass", "shard", place.alias("place"))
    return docs.select("id", "source", "size", "source_size", "target"), draws


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **sizes) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, shards.

    taken: words that the mix takes of it, repeats counted. shards: where its
    copies go. Null and empty texts have no words and are never taken; a null
    source is a source of its own, a source without words has target 0. Integer
    ids without repeats, and a row without one is never taken; an empty table gives an empty result. A source misses
    its target by less than its shortest document, if its documents, three copies
    of each, suffice without those that are longer than what is missing.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{source_column}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_column}`")).alias("size"),
    )
    table, draws = plan_mix(rows, **sizes)
    copies = draws.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.sort_array(F.collect_list("shard")).alias("shards"))
    out = table.join(copies, "id", "left")
    return out.select(
        F.col("id").alias(id_column),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.coalesce("copies", F.lit(0))).cast("long").alias("taken"),
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"),
    )


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **sizes) -> DataFrame:
    """The mixture itself: one row per copy taken, with the document's columns.

    Adds mix_pass, mix_shard and mix_place; a shard's rows ordered by mix_place
    are its locally shuffled content. Columns of these names are replaced. A row
    without an id is never taken.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{source_column}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_column}`")).alias("size"),
    )
    _, draws = plan_mix(rows, **sizes)
    kept = [c for c in docs.columns if c not in ("mix_pass", "mix_shard", "mix_place")]
    draws = draws.select(
        F.col("id").alias("mix_id"), F.col("pass").alias("mix_pass"), F.col("shard").alias("mix_shard"), F.col("place").alias("mix_place")
    )
    own = only(docs, *kept)
    return own.join(draws, own[id_column].cast("long") == draws["mix_id"]).drop("mix_id")
