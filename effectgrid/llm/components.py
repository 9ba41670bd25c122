"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.llm.tables import stored

#: Links that one task may contract at a time: about 50 MB.
TASK_LINKS = 500_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links, and for each the smallest node that they reach."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        # the labels' own roots learn of the smaller ones, then all nodes jump to their roots
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) as links of every node with the smallest one, TASK_LINKS at a time."""
    held: list[pa.RecordBatch] = []

    def out():
        t = pa.Table.from_batches(held)
        nodes, low = smallest_reachable(t["u"].to_numpy(), t["v"].to_numpy())
        other = nodes != low
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(low[other])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TASK_LINKS:
            yield from out()
            held = []
    if held:
        yield from out()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component: smallest node reachable.

    Links that fit one task are contracted there. More are contracted in the
    tasks that hold them and then by alternating star contractions: each round
    hangs larger neighbours, then smaller ones, on the smallest node known;
    depth falls fast, so rounds grow with the logarithm of the longest path.
    Minima are combined before they are shuffled, so a node with a third of all
    links is no hot task; no node's neighbours are gathered.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if links.limit(TASK_LINKS + 1).count() <= TASK_LINKS:
        return _stars(stored(edges.coalesce(1).mapInArrow(_contract, "u long, v long")))
    edges = stored(edges.mapInArrow(_contract, "u long, v long").distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        after = stored(small.select("e.u", "e.v").where("u <> v").distinct())
        # stars at last: nothing that hangs on a node has anything hanging on it
        if after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty():
            return _stars(after)
        edges = after


def _stars(links: DataFrame) -> DataFrame:
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
