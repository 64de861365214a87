"""Connected components of an edge table.

Each task first reduces its own edges to stars (union-find over what it holds, without a shuffle). A
table of at most FEW edges, a bounded size, is then finished by one task in the same way. A larger one
goes through alternating large-star and small-star steps until it is that small or no longer changes:
each step is a minimum per node (partially aggregated) and a join of the edges with it, in which the
minimum is repeated over SALTS so that the edges of a centre are dealt over as many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import workers_import, written

FEW = 100_000
SALTS = 16


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of each node of the edges but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))  # nodes are sorted: the smaller place is the smaller node
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for k, x in enumerate(parent):  # parents are smaller and come first
        parent[k] = parent[x]
    root = np.array(parent, np.int64)
    own = root == np.arange(len(nodes))
    return nodes[~own], nodes[root[~own]]


def _contract(rows: DataFrame, held: int) -> DataFrame:
    """rows (u, v) of each task as stars; a task takes up to ``held`` edges at a time."""
    workers_import(rows.sparkSession)

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, n = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            x, y = stars_of(np.concatenate(u), np.concatenate(v))
            for lo in range(0, len(x), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]), pa.array(y[lo : lo + 100_000])], ["u", "v"])

        for b in batches:
            u.append(b.column(0).to_numpy(zero_copy_only=False))
            v.append(b.column(1).to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n > held:
                yield from flush()
                u, v, n = [], [], 0
        if n:
            yield from flush()

    return rows.mapInArrow(contract, "u long, v long")


def _counted(stars: DataFrame) -> tuple[DataFrame, tuple]:
    """stars, written, and its number of rows with a fingerprint, taken in the same pass."""
    seen = Observation()
    out = written(stars.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")))
    found = seen.get  # empty where nothing was left to run
    return out, (found.get("n", 0), found.get("mark"))


def components(edges: DataFrame, few: int = FEW, salts: int = SALTS, held: int = 1_000_000) -> DataFrame:
    """edges (a long, b long; loops and repeats allowed) to node, component: the smallest node that each node of an edge can reach.

    Null ends are dropped; no edges give no rows. Nodes without edges are not returned.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    stars, mark = _counted(_contract(links, held))
    while mark[0] > few:
        # large star: larger neighbours move to the smallest neighbour
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _to_lowest(both.where("v > u"), low, salts).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        # small star: smaller neighbours and the node itself move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _to_lowest(large, low, salts).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        before = mark
        stars, mark = _counted(small.distinct())
        if before == mark:
            break
    if 0 < mark[0] <= few:
        stars = written(_contract(stars.coalesce(1), few))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())


def _to_lowest(rows: DataFrame, low: DataFrame, salts: int) -> DataFrame:
    """rows (u, v) with m of low (u, m); the rows of one u are dealt over salts."""
    low = low.select(F.col("u").alias("w"), "m", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    return rows.withColumn("salt", F.pmod(F.hash("v"), F.lit(salts))).join(low, (F.col("u") == F.col("w")) & (F.col("salt") == F.col("s")))


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of links that join what the ones before have not joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return kept
