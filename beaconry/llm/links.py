"""Connected components of a link table, by alternating star contractions.

Each round writes its edges to the shared folder, so lineage stays short and a lost executor repeats one round.  No
task holds the links of a node: smallest neighbours come from partial aggregates, and are joined back to the edges.
Tasks first contract the links they happen to hold, which leaves a forest of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, arrow_map


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[root]


def contract(edges: DataFrame) -> DataFrame:
    def run(it):
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in it:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            if sum(map(len, a)) > 1 << 21:
                n, r = roots(np.concatenate(a), np.concatenate(b))
                a, b = [n[n != r]], [r[n != r]]
        n, r = roots(np.concatenate(a), np.concatenate(b))
        yield {"u": n[n != r], "v": r[n != r]}

    return arrow_map(edges, run, "u long, v long")


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """edges (two long columns; neither null) -> id, root for every node with a link; root is the smallest id reachable."""
    a, b = edges.columns
    now = tables.cut(contract(edges.filter(F.col(a) != F.col(b)).select(a, b)).distinct())
    sign = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or sign == tuple(row):
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        sign = tuple(row)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        then = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        old, now = now, tables.cut(then)
        tables.drop(old)
