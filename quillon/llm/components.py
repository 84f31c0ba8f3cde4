"""Connected components of an edge table, without gathering it.

Every task contracts what it holds to stars around the smallest node (a forest: never more edges than came in), at the
start and after each shuffle; so a small table, which AQE gives to one task, is closed by the first. Each round then looks
at every edge from both of its ends: the larger neighbours of a node are hung from the smallest node around it, then the
smaller ones are (large-star and small-star). No round makes more edges or raises a root, and while a node hangs from two
roots, or from one that hangs itself, some root gets smaller; so the rounds end, when every node hangs from one root that
hangs from none. Each round is written to the shared folder, so a lost executor costs one task. The path is the same for
every size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffled

EDGES = "node long, root long"


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n indices by links a-b."""
    lab = np.arange(n)
    while len(a):
        x, y = lab[a], lab[b]  # roots
        low = np.minimum(x, y)
        np.minimum.at(lab, x, low)
        np.minimum.at(lab, y, low)
        while not np.array_equal(lab, up := lab[lab]):
            lab = up
        apart = lab[a] != lab[b]
        a, b = a[apart], b[apart]
    return lab


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their smallest reachable node, without the roots themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[labels(at[: len(a)], at[len(a) :], len(nodes))]
    hang = root != nodes
    return nodes[hang], root[hang]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) > 1_000_000:  # contracted on the way: memory follows the nodes, not the edges
            a, b = stars(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
            held = []
    a, b = stars(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
    for i in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], ["node", "root"])


def _large_star(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours hang from the smallest of the node and its neighbours."""
    around = e.select(F.col("root").alias("x"), F.col("node").alias("y")).unionAll(e.select("node", "root"))
    least = materialize(around.groupBy("x").agg(F.least("x", F.min("y")).alias("least")), "least")  # a plain shuffle in the join, which AQE can split at a hub
    hung = e.join(shuffled(least), e["root"] == least["x"]).select("node", F.col("least").alias("root"))
    return materialize(hung.distinct().mapInArrow(_contract, EDGES), "edges")


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours hang from the smallest of these."""
    least = materialize(e.groupBy(F.col("node").alias("x")).agg(F.min("root").alias("least")), "least")
    hung = e.join(shuffled(least), e["node"] == least["x"]).where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
    return materialize(hung.unionAll(least.select("x", "least")).distinct().mapInArrow(_contract, EDGES), "edges")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node that has an edge to another; edges has two long columns.

    Null ends and loops link nothing; repeated edges count once; no edges give an empty table."""
    a, b = edges.columns
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
    e = e.mapInArrow(_contract, EDGES).distinct().mapInArrow(_contract, EDGES)
    e = materialize(e, "edges")
    while True:
        ends = e.select(F.col("node").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(e.select("root", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs + holds > 1")
        if open_.isEmpty():
            break
        e = _small_star(_large_star(e))
    roots = e.select(F.col("root").alias("node"), "root").distinct()
    return e.unionAll(roots)
