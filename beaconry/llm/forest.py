"""Embedding near-dedup by a forest of random-projection trees.

1. Equal vectors form a class, whose smallest id stands for it.
2. Trees split recursively until a leaf holds `leaf` classes on average, whatever their number.  A node of the first
   FITTED levels splits at the median of a bounded sample's projections on its own random direction; deeper nodes, which
   the sample doesn't reach, at a quantile (drawn from the node's number) of the sample's projections on the level's
   direction.  A vector whose projection lies within a margin of the threshold goes down both sides (spill), so close
   pairs are seldom parted: with the margin of half the spread of a linked pair's gap, some 3 % of borderline pairs per
   level and tree.
3. Vectors of a leaf are compared, large leaves in blocks of bounded size, whatever their number.  A single-precision
   product selects, double precision decides.  A pair counts in the first leaf that its two vectors share, so no
   pairs need to be emitted or made distinct: leaves give counts and a spanning forest of their links.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Vectors of different
lengths never link.  A null id counts as -1; rows that share an id are one node.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, arrow_map, batches, mix
from .links import components, roots

BLOCK = 4096
#: levels whose nodes have thresholds of their own, 2 ** FITTED of them for each tree
FITTED = 12


class Forest:
    """Thresholds of complete binary trees of one depth; directions follow from the seed and the vectors' length."""

    def __init__(self, sample: list[np.ndarray], depth: int, trees: int, margin: float, seed: int = 7):
        self.depth, self.trees, self.margin, self.seed = depth, trees, margin, seed
        self.top = min(depth, FITTED)
        self.cuts: dict[int, np.ndarray] = {}
        self.quantiles: dict[int, np.ndarray] = {}
        self.axes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list] = {}
        for v in sample:
            by.setdefault(len(v), []).append(v)
        for dim, vs in by.items():
            x, (axes, deep) = np.array(vs), self.directions(dim)
            self.cuts[dim] = np.stack([self.fit(x, axes[t]) for t in range(trees)])
            # between the quartiles, so that no side is nearly empty
            self.quantiles[dim] = np.quantile(np.einsum("nd,tld->tln", x, deep), np.linspace(0.25, 0.75, 16), axis=2).transpose(1, 2, 0)
        self.axes.clear()

    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the nodes of the fitted levels, and of each deeper level."""
        if dim not in self.axes:
            rng = np.random.default_rng([self.seed, dim])
            both = [rng.standard_normal((self.trees, n, dim)) for n in (2**self.top - 1, self.depth - self.top)]
            self.axes[dim] = tuple(a / np.linalg.norm(a, axis=2, keepdims=True) for a in both)
        return self.axes[dim]

    def fit(self, x: np.ndarray, axes: np.ndarray) -> np.ndarray:
        cuts, members = np.zeros(len(axes)), {0: np.arange(len(x))}
        for k in range(len(axes)):
            own = members.pop(k, ())
            if len(own):
                p = x[own] @ axes[k]
                cuts[k] = np.median(p)
                members[2 * k + 1], members[2 * k + 2] = own[p < cuts[k]], own[p >= cuts[k]]
        return cuts

    def leaves(self, u: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, leaf numbers) of unit vectors, one pair of arrays for each tree."""
        dim, inner = u.shape[1], 2**self.depth - 1
        (axes, deep), out = self.directions(dim), []
        cuts = self.cuts.get(dim, np.zeros((self.trees, 2**self.top - 1)))
        quantiles = self.quantiles.get(dim, np.zeros((self.trees, self.depth - self.top, 16)))
        tau = self.margin / math.sqrt(dim)
        for t in range(self.trees):
            row, node = np.arange(len(u)), np.zeros(len(u), np.int64)
            for level in range(self.depth):
                if level < self.top:
                    gap = np.einsum("ij,ij->i", u[row], axes[t][node]) - cuts[t][node]
                else:
                    pick = mix(node.astype(np.uint64)) % np.uint64(16)
                    gap = (u @ deep[t][level - self.top])[row] - quantiles[t][level - self.top][pick]
                left, right = gap < tau, gap >= -tau
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            out.append((row, node - inner + t * (inner + 1)))
        return out


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, id (-1 for none), v (doubles as bytes; null where the vector links with nothing)."""

    def run(it):
        for b in it:
            out = []
            for x in b.column(2).to_pylist():
                v = np.array(x, np.float64) if x and None not in x else np.zeros(0)
                with np.errstate(over="ignore"):
                    out.append(v.tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
            yield {"vec_id": b.column(0), "id": b.column(1), "v": out}

    return arrow_map(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("vec_id").cast("long"), F.lit(-1)).alias("id"), F.col("embedding").cast("array<double>")), run, "vec_id long, id long, v binary")


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def hits(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at or above the threshold."""
    i, j = np.nonzero(x.astype(np.float32) @ y.T.astype(np.float32) >= threshold - 1e-5)
    ok = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65536]], y[j[a : a + 65536]]) for a in range(0, max(1, len(i)), 65536)]) >= threshold
    return i[ok], j[ok]


def compare_leaves(rows: DataFrame, threshold: float) -> DataFrame:
    """kind 0: a has b more links; kind 1: a and b are linked (a spanning forest of each block)."""
    blocks = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    grouped = blocks.groupBy("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("id", "c", "v", "leaves", (F.col("own") > F.col("other")).alias("right"))).alias("rows"))

    def pairs(leaf, same, ids, c, v, leaves, right):
        l, r = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~right), np.flatnonzero(right))
        add, a, b = np.zeros(len(ids), np.int64), [], []
        # the leaves that come before this one, each row's in order; the fillers meet nothing
        width = max(1, max(map(len, leaves)))
        before = np.full((len(ids), width), -1, np.int32)
        for k, x in enumerate(leaves):
            before[k, : len(x)] = x
        before[before >= leaf] = -1
        other = np.where(before < 0, -2, before)
        for s in range(0, len(l), 512):
            own = l[s : s + 512]
            i, j = hits(v[own], v[r], threshold)
            i, j = own[i], r[j]
            ok = ids[i] != ids[j]
            if same:
                ok &= i < j
            i, j = i[ok], j[ok]
            for t in range(0, len(i), 1 << 14):
                x, y = i[t : t + (1 << 14)], j[t : t + (1 << 14)]
                new = np.ones(len(x), bool)
                for k in range(width):
                    new &= ~(before[x] == other[y, k][:, None]).any(1)
                x, y = x[new], y[new]
                np.add.at(add, x, c[y])
                np.add.at(add, y, c[x])
                n, root = roots(ids[x], ids[y])
                a.append(n[n != root])
                b.append(root[n != root])
        got = np.flatnonzero(add)
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        n, root = roots(a, b)
        a, b = n[n != root], root[n != root]
        return {"kind": np.repeat(np.array([0, 1], np.int32), [len(got), len(a)]), "a": np.concatenate([ids[got], a]), "b": np.concatenate([add[got], b])}

    def run(it):
        for batch in it:
            for leaf, i, j, rows in zip(*(c.to_pylist() for c in batch.columns)):
                by: dict[int, list] = {}
                for x in rows:
                    by.setdefault(len(x["v"]), []).append(x)
                for own in by.values():
                    v = unit(np.frombuffer(b"".join(x["v"] for x in own)).reshape(len(own), -1))
                    yield pairs(leaf, i == j, np.array([x["id"] for x in own]), np.array([x["c"] for x in own]), v, [x["leaves"] for x in own], np.array([x["right"] for x in own]))

    return arrow_map(grouped.select("leaf", "i", "j", "rows"), run, "kind int, a long, b long")


def near_vectors(table: DataFrame, threshold: float = 0.9, trees: int = 5, leaf: int = 512, sample: int = 8192, spill: float = 0.5) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    sample: vectors, those with the smallest hashes of their ids, to which the thresholds are fitted on the driver.
    spill: the margin in spreads of a linked pair's gap; more finds more and compares more."""
    spark = table.sparkSession
    batches(spark, 1000)
    tables = Tables(spark, "forest")
    every = tables.cut(vectors(table))
    classes = tables.cut(every.filter("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("c"), F.count_distinct("id").alias("d")))
    n = classes.count()
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
    fit = [unit(np.frombuffer(r["v"])) for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").collect()]
    forest = Forest(fit, depth, trees, spill * math.sqrt(2 - 2 * threshold))

    def assign(it):
        for b in it:
            ids, c, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            lens = np.array([len(x) for x in v])
            for length in np.unique(lens):
                own = np.flatnonzero(lens == length)
                u = unit(np.frombuffer(b"".join(v[k] for k in own)).reshape(len(own), -1))
                found = forest.leaves(u)
                row, node = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
                order = np.lexsort((node, row))
                lists = np.split(node[order].astype(np.int32), np.cumsum(np.bincount(row, minlength=len(own)))[:-1])
                yield {"id": ids[own], "c": c[own], "v": [v[k] for k in own], "leaves": lists}

    placed = tables.cut(arrow_map(classes.select(F.col("rep").alias("id"), F.col("d").alias("c"), "v"), assign, "id long, c long, v binary, leaves array<int>"))
    deal = placed.withColumn("leaf", F.explode("leaves"))
    counts = deal.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("k"))
    found = tables.cut(compare_leaves(deal.join(counts, "leaf"), threshold))
    more = found.filter("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("more"))
    links = found.filter("kind = 1").select("a", "b")
    joined = tables.cut(every.join(classes.filter("c > 1").select("v", "rep", "d"), "v", "left").select("vec_id", "id", F.coalesce("rep", "id").alias("rep"), F.coalesce("d", F.lit(1)).alias("d")))
    top = tables.cut(components(links.unionByName(joined.filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))), tables))
    out = joined.join(more.withColumnRenamed("id", "rep"), "rep", "left").join(top.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("vec_id", (F.col("d") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"), (F.col("id") == F.coalesce("root", "rep")).alias("kept"))
