"""Best-fit packing of tokenised documents into fixed-length sequences.

Best-fit decreasing puts each piece, longest first, into the open bin with the tightest room that still holds it.
Pieces of one length are interchangeable, so the whole course of the algorithm follows from the number of pieces of
each length: at most `capacity` counts.  The driver runs it on those counts, with a segment tree over remaining
capacities that finds the tightest open bin in logarithmic time and moves whole runs of bins at once.  The result is
a plan (length, ranks from..to -> bins from.., offset) whose size depends on the capacity and not on the data; every
piece looks its place up by its rank among the pieces of its length.  Ranks are taken within (length, salt) groups, so
no one task holds all pieces of a frequent length.

A null text counts as empty and is one piece holding the end token alone.  Repeated rows are packed repeatedly.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, arrow_map, batches, parts, texts

DOUBLED = re.compile(r"\s\s")


class BpeIds:
    """ids of a byte-level BPE vocabulary as little-endian 32-bit bytes, exactly as the tokenizers library gives them.

    With `ranks` (the same vocabulary for tiktoken, which gives the same ids several times faster) only texts that
    hold a special string go to the library.  Texts without doubled white space are cut by a pattern without
    look-ahead, which cuts them alike and faster."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.fast = self.full = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            make = lambda p: tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=table, special_tokens={}).encode_ordinary
            self.full, self.fast = make(pattern), make(pattern.replace(r"|\s+(?!\S)", ""))

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if self.full is None or any(x in text for x in self.special):
            ids = self.whole(text)
        else:
            ids = self.full(text) if DOUBLED.search(text) else self.fast(text)
        return array("I", ids).tobytes()


_IDS: dict[tuple, BpeIds] = {}


def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> BpeIds:
    key = (path, ranks, pattern)
    if key not in _IDS:
        _IDS[key] = BpeIds(path, ranks, pattern)
    return _IDS[key]


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Each document's ids and the end id, cut into pieces of `capacity`, a shorter one first."""
    batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(it):
        enc = encoder(path, ranks, pattern)
        for b in it:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for i, t in zip(b.column(0).to_pylist(), texts(b)):
                raw = enc.encode(t) + end
                n = len(raw) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    for c, v in zip(out.values(), (i, k, x, y - x, zlib.crc32(memoryview(raw)[4 * x : 4 * y]))):
                        c.append(v)
            yield out

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Which remaining capacities have open bins: the smallest one that is at least x, in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.has = [False] * (2 * self.size)

    def set(self, x: int, on: bool) -> None:
        x += self.size
        self.has[x] = on
        while x > 1:
            x >>= 1
            self.has[x] = self.has[2 * x] or self.has[2 * x + 1]

    def tightest(self, x: int) -> int | None:
        i = x + self.size
        while not self.has[i]:
            while i & 1:  # a right child: nothing larger under its parent
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.has[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, number, offset), by length and rank: ranks r..r+n-1 go to bins b..b+n-1."""
    tree, runs, plan, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, None
            else:
                first, n = runs[room].pop()
            # a bin that took one stays the tightest fit until this length no longer goes into it
            per = room // length
            full, rest = divmod(left if n is None else min(left, n * per), per)
            used = full + (rest > 0)
            for k in range(per if full else 0):
                plan.append((length, rank, first, full, capacity - room + k * length))
                rank += full
            for k in range(rest):
                plan.append((length, rank, first + full, 1, capacity - room + k * length))
                rank += 1
            left -= full * per + rest
            if n is None:
                bins += used
            else:
                if n > used:
                    runs[room].append((first + used, n - used))
                if not runs[room]:
                    tree.set(room, False)
            push(runs, tree, room - per * length, first, full)
            push(runs, tree, room - rest * length, first + full, 1 if rest else 0)
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def push(runs: dict, tree: CapacityTree, room: int, first: int, n: int) -> None:
    if room > 0 and n > 0:
        runs.setdefault(room, []).append((first, n))
        tree.set(room, True)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (a column `length` of 1..capacity, written so that a reread gives the same rows) with sequence_id, offset."""
    spark = pieces.sparkSession
    salts = parts(spark)
    keys = [c for c in pieces.columns if c != "length"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    # at most `capacity` rows reach the driver
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    key = plan[:, 0] << 40 | plan[:, 1]
    cols = list(pieces.columns)
    ranked = (
        salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)) - 1)
        .join(before, ["length", "_salt"])
        .select(*cols, (F.col("_rank") + F.col("_before")).alias("_rank"))
    )

    def run(it):
        for b in it:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            yield {c: b.column(i) for i, c in enumerate(cols)} | {"sequence_id": plan[at, 2] + rank - plan[at, 1], "offset": plan[at, 4]}

    kinds = dict(pieces.dtypes)
    return arrow_map(ranked, run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    t = Tables(docs.sparkSession, "packing")
    return pack(t.cut(tokenised_pieces(docs, path, capacity, end_id, ranks, pattern)), capacity)
