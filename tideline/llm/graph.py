"""Connected components by repeated contraction, for edge sets larger than a machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import cut


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each of 0..n-1's component under the links (i, j)."""
    label = np.arange(n, dtype=np.int64)
    while len(i):
        li, lj = label[i], label[j]
        open_ = li != lj
        i, j, li, lj = i[open_], j[open_], li[open_], lj[open_]
        if not len(i):
            break
        np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _finished(batches):
    """The rounds that are left of a graph of few edges, in one task."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = local_components(len(nodes), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "to"])


def components(edges: DataFrame, small: int = 0) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long); component is some node of it, the same for all its nodes.

    Every round each node moves to the least of its closed neighbourhood and the graph is contracted to these.
    Rounds alternate between the order of the ids, which collapses stars in one step, and a fresh random order,
    which at least halves any other graph in expectation, long paths included. Every round's tables are written to the shared
    folder, and joined by shuffling at any size, so that the driver holds none of them. Once `small` edges at most are left, one
    task does the rounds that remain, since every round's plans take memory of the driver. No edges: an empty result.
    """
    graph = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    moved: DataFrame | None = None
    k = 0
    while left := graph.count():
        last = left <= small

        def order(c, k=k):
            return F.struct(F.lit(0).alias("h") if k % 2 == 0 else F.xxhash64(c, F.lit(k)).alias("h"), c.alias("v"))

        both = graph.select("a", "b").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        if last:
            step = cut(graph.select("a", "b").repartition(1).mapInArrow(_finished, "node long, to long"), "step")
        else:
            step = cut(least.select(F.col("a").alias("node"), F.least(F.col("m"), order(F.col("a")))["v"].alias("to")), "step")
            first, second = step.toDF("a", "ra"), step.toDF("b", "rb")
            graph = cut(graph.join(first.hint("merge"), "a").join(second.hint("merge"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if moved is None:
            moved = step
        else:
            moved = cut(moved.join(step.toDF("to", "next").hint("merge"), "to", "left").select("node", F.coalesce("next", "to").alias("to")), "moved")
        if last:
            break
        k += 1
    if moved is None:
        moved = graph.select(F.col("a").alias("node"), F.col("b").alias("to"))
    return moved.select("node", F.col("to").alias("component"))
