"""Benchmark decontamination by exact comparison of all item-sized windows.

Words are lower-cased runs of letters, digits and underscores.  A document is compared with each benchmark item by
windows of the item's number of words:

1. Only windows that hold a shingle (five words) of an item can be similar to it, so items follow from a look-up of the
   document's shingles among the items'.
2. Every window around these hits is compared.  An occurrence of a shingle counts in the windows that hold it and fewer
   earlier occurrences than the item has, which is one run of starts; summing the runs' ends gives the weighted overlap
   of all windows at once, without a loop over them.
3. The weighted Jaccard similarity of the shingles, counted with their repeats, decides: 0.8 or more is a leak.

No window is left out and nothing is estimated: the result is that of an exhaustive scan.  128-bit SimHash prints in a
multi-index (16 blocks of 8 bits; prints within 40 bits differ by 2 or less in some block) answer Index.within; the scan
doesn't ask it, as prints of texts that differ in one often repeated shingle can be further apart than any radius.

An item of fewer than five words is one shingle of all its words.  Null and empty texts, and items without words, match
nothing.  The items, a stated query set, are held by each task in parts of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, U64, arrow_map, batches, grams, mix, texts

WORD = re.compile(r"\w+")
BITS, BLOCKS, RADIUS = 128, 16, 40
#: words of items that one pass over the documents compares with
PART_WORDS = 4_000_000
_POP = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def words(text: str) -> np.ndarray:
    return HASHES.of([w.encode("utf8", "surrogatepass") for w in WORD.findall(text.lower())])


def simhash(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16 bytes: the sign of each bit's weighted sum."""
    raw = np.stack([shingles, mix(shingles ^ U64(0xA0761D6478BD642F))], axis=1).view(np.uint8)
    bits = np.unpackbits(raw, axis=1).astype(np.int64)
    return np.packbits((2 * bits - 1).T @ counts > 0)


class Index:
    """Items by shingle and by blocks of their SimHash."""

    def __init__(self, items: list[tuple[int, str]], size: int = 5):
        self.ids, self.sets, self.totals, places = [], [], [], []
        for item, text in items:
            v = words(text)
            if not len(v):
                continue
            m = min(size, len(v))
            g, n = np.unique(grams(v, m), return_counts=True)
            places += [(h, len(self.ids), k, m) for h, k in zip(g.tolist(), n.tolist())]
            self.ids.append(item)
            self.sets.append((g, n))
            self.totals.append(int(n.sum()))
        places.sort()
        self.hash = np.array([p[0] for p in places], U64)
        self.item, self.weight, self.gram = (np.array([p[k] for p in places], np.int64) for k in (1, 2, 3))
        self.total = np.array(self.totals, np.int64)
        self.grams = sorted(set(self.gram.tolist()))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hash >> U64(44)).astype(np.int64)] = True

    @cached_property
    def prints(self) -> np.ndarray:
        return np.stack([simhash(*s) for s in self.sets]) if self.ids else np.zeros((0, 16), np.uint8)

    @cached_property
    def blocks(self) -> list[np.ndarray]:
        """blocks[k][value]: which items have a block k within two bits of value."""
        near = _POP[np.arange(256)[:, None] ^ np.arange(256)] <= RADIUS // BLOCKS
        return [near[:, self.prints[:, k]] for k in range(BLOCKS)]

    def within(self, window: np.ndarray) -> np.ndarray:
        """Items whose fingerprint is within the radius."""
        some = np.zeros(len(self.ids), bool)
        for k in range(BLOCKS):
            some |= self.blocks[k][window[k]]
        some = np.flatnonzero(some)
        return some[_POP[self.prints[some] ^ window].sum(1) <= RADIUS]

    def scan(self, text: str, threshold: float) -> list[tuple[int, int, float]]:
        """(item, start, similarity) of the best window, the first of equal ones, for each item that reaches the threshold."""
        v, out = words(text), []
        for m in self.grams:
            g = grams(v, m)
            at = np.flatnonzero(self.filter[(g >> U64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hash, g[at], "left"), np.searchsorted(self.hash, g[at], "right")
            n = hi - lo
            if not n.any():
                continue
            # one row for each place in the document and entry of the index
            pos = np.repeat(at, n)
            k = np.arange(len(pos)) + np.repeat(lo - (np.cumsum(n) - n), n)
            pos, k = pos[self.gram[k] == m], k[self.gram[k] == m]
            order = np.lexsort((pos, k))
            pos, k = pos[order], k[order]
            item, rows = self.item[k], np.arange(len(k))
            width = np.minimum(self.total[item], len(g))
            # an entry's occurrence counts from where the one `weight` places before it has left the window
            before = rows - self.weight[k]
            early = np.where((before >= 0) & (k[before] == k), pos[before], -1)
            first = np.maximum(np.maximum(early, pos - width) + 1, 0)
            last = np.minimum(pos, len(g) - width)
            ok = first <= last
            who, where = np.tile(item[ok], 2), np.concatenate([first[ok], last[ok] + 1])
            step = np.repeat([1, -1], ok.sum())
            order = np.lexsort((where, who))
            who, where, both = who[order], where[order], np.cumsum(step[order])
            # the sum holds from the last of equal places on
            end = np.append((who[1:] != who[:-1]) | (where[1:] != where[:-1]), True)
            who, where, both = who[end], where[end], both[end]
            sim = both / (np.minimum(self.total[who], len(g)) + self.total[who] - both)
            best = np.lexsort((where, -sim, who))
            best = best[np.append(True, who[best][1:] != who[best][:-1])] if len(best) else best
            best = best[sim[best] >= threshold]
            out += zip(who[best].tolist(), where[best].tolist(), sim[best].tolist())
        return [(self.ids[i], s, x) for i, s, x in sorted(out)]


def item_parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded size, one at least."""
    part, total = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").orderBy("item_id")
    for r in rows.toLocalIterator():
        part.append((r["item_id"], r["text"]))
        total += len(r["text"].split())
        if total > PART_WORDS:
            yield part
            part, total = [], 0
    yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """doc_id, item_id, start (word), similarity: one row for each document and item with a window that similar."""
    batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scanned(items):
        def run(it):
            index = Index(items, size)
            for b in it:
                rows = [(d, *r) for d, t in zip(b.column(0).to_pylist(), texts(b)) for r in index.scan(t, threshold)]
                yield {k: [r[i] for r in rows] for i, k in enumerate(("doc_id", "item_id", "start", "similarity"))}

        return arrow_map(source, run, "doc_id long, item_id long, start long, similarity double")

    found, *more = map(scanned, item_parts(benchmark))
    for x in more:
        found = found.unionByName(x)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of docs whose text has no window that similar to an item.  Each row is judged by itself, whatever its id."""
    batches(docs.sparkSession)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)

    def cleaned(source, items):
        def run(it):
            index = Index(items, size)
            for b in it:
                ok = pa.array([not index.scan(t, threshold) for t in texts(b)], pa.bool_())
                yield {c: b.column(k).filter(ok) for k, c in enumerate(b.schema.names)}

        return arrow_map(source, run, schema)

    for part in item_parts(benchmark):
        docs = cleaned(docs, part)
    return docs
