"""Connected components of a graph of long ids, by alternating large and small stars; a small graph in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, stored


#: Different edges, 16 bytes each, up to which one task takes the whole graph. Beyond that the stars do.
ONE_TASK = 1_000_000


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the components of a[i] and b[i] made one; a label is the least place in its component."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) of a graph."""
    held = [[c.to_numpy() for c in b.columns] for b in batches]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = nodes[join_labels(np.arange(len(nodes)), at[: len(u)], at[len(u) :])]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of every node of an edge (a, b) between two nodes; root is the least id of its component.

    Each round hangs every node on the least id it can see; the number of rounds follows the logarithm of the
    longest path. Rounds end in the shared folder, so a lost executor costs one round; a round's tables go when the next is stored. Neighbours of a node are
    never gathered: a hub is a key of a join that Spark can split. Self-links and repeated links are allowed.

    A graph of up to one_task different edges goes through one task instead: the rounds of such a graph cost jobs, tasks
    and the driver's memory, not work. The roots are the same.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(now, "edges")
    state = _state(now)
    if state[0] <= one_task:
        roots = stored(now.coalesce(1).mapInArrow(_whole, "node long, root long"), "roots")
        discard(now)
        return roots
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(last, large)
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
