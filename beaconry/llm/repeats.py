"""Repeated windows of a corpus, by super-k-mers; shared by the substring and the suffix-array operators.

1. Every task cuts its documents into paths (superkmers.py).  Paths equal to one of the same Arrow batch are settled
   there, by comparing the source texts at their coordinates; one of them goes on, so a frequent passage crosses the
   network once per batch.
2. Paths meet by key, bucket by bucket: a task sorts its buckets and holds one at a time.  Buckets are measured first;
   one above HEAVY bytes is dealt to several groups, each of which sends on one path for each key, so that a hot key is
   split before it meets.
3. A key of a single path holds no repeated window.  Several paths are either compared as wholes here (equal ones become
   spans with the coordinates of what they repeat, others are handed on), or all handed on.  What is handed on is looked
   up in its source texts again, by the coordinates it carries.

A document is known by its id and a 32-bit tag of its text, so rows that share an id but not a text are kept apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, arrow_map, batches, group_starts, parts, texts
from .superkmers import PATH, paths

RUN = np.dtype([("start", "<i4"), ("n", "<i4")])
#: n windows from start on repeat those from sstart on of another document
SPAN = np.dtype([("start", "<i4"), ("n", "<i4"), ("sdoc", "<i8"), ("stag", "<u4"), ("sstart", "<i4")])
AMBIGUOUS = np.dtype([("start", "<i4"), ("n", "<i4"), ("key", "<u8"), ("sub", "<i4")])
#: pieces of one key that one task compares; further ones go to other tasks and are merged there
SPLIT = 4096
#: buckets for each shuffle partition, and packed bytes of one that a task holds
SUB, HEAVY = 4, 32 << 20
#: flag of a path whose key is known to be handed on, as the path itself was
OPEN = 2
ROWS = "bucket int, salt int, doc long, tag long, kind int, blob binary"


@dataclass
class Units:
    """A text as values (of words or bytes) and the bytes they stand for; ends has where each unit ends, None for bytes."""

    values: np.ndarray
    raw: bytes
    ends: np.ndarray | None = None

    def part(self, a: int, b: int) -> bytes:
        if self.ends is None:
            return self.raw[a:b]
        return self.raw[int(self.ends[a - 1]) + 1 if a else 0 : int(self.ends[b - 1])]


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc (its id, -1 for none), tag, text, and columns that are passed on."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), (F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))).alias("tag"), F.coalesce("text", F.lit("")).alias("text"), *more)


def pack_columns(rec: np.ndarray) -> bytes:
    """Column after column, which compresses better than row after row; a few rows stay as they are."""
    import zstandard

    raw = len(rec).to_bytes(8, "little") + b"".join(np.ascontiguousarray(rec[f]).tobytes() for f in rec.dtype.names)
    return b"\0" + raw if len(raw) < 1024 else b"\1" + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_columns(blob: bytes, dtype: np.dtype) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[0] else blob[1:]
    out, at = np.empty(int.from_bytes(raw[:8], "little"), dtype), 8
    for f in dtype.names:
        kind = dtype[f]
        out[f] = np.frombuffer(raw, kind, len(out), at)
        at += len(out) * kind.itemsize
    return out


def per_document(doc: np.ndarray, tag: np.ndarray, rec: np.ndarray, kind: int) -> dict:
    """Rows of rec gathered into one blob for each document."""
    order = np.lexsort((tag, doc))
    doc, tag, rec = doc[order], tag[order], rec[order]
    at = group_starts(doc, tag)
    raw, size = rec.tobytes(), rec.itemsize
    ends = np.append(at[1:], len(doc))
    none = np.zeros(len(at), np.int32)
    return {"bucket": none, "salt": none, "doc": doc[at], "tag": tag[at].astype(np.int64), "kind": np.full(len(at), kind, np.int32), "blob": [raw[a * size : b * size] for a, b in zip(at.tolist(), ends.tolist())]}


def settle(p: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one path of each distinct content, the others that repeat it, which of the first each one repeats).

    With `every`, equal rows of the table repeat each other.  Without, a path at the same place of the same id doesn't."""
    p = p[np.lexsort((p["start"], p["tag"], p["doc"], p["content"], p["key"]))]
    at = group_starts(p["key"], p["content"])
    head = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(p))))
    first = at[head]
    rest = np.arange(len(p)) != first if every else (p["doc"] != p["doc"][first]) | (p["start"] != p["start"][first])
    return p[at], p[rest], head[rest]


def chains(rest: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where chains begin in it): neighbouring paths whose sources are neighbours too."""
    order = np.lexsort((rest["start"], source["tag"], source["doc"], rest["tag"], rest["doc"]))
    r, s = rest[order], source[order]
    if not len(r):
        return order, np.zeros(0, np.int64)
    same = (r["doc"][1:] == r["doc"][:-1]) & (r["tag"][1:] == r["tag"][:-1]) & (s["doc"][1:] == s["doc"][:-1]) & (s["tag"][1:] == s["tag"][:-1])
    same &= (r["start"][1:] == r["start"][:-1] + r["n"][:-1]) & (s["start"][1:] == s["start"][:-1] + r["n"][:-1])
    return order, np.flatnonzero(np.append(True, ~same))


def settle_batch(p: np.ndarray, units: list[Units], tags: np.ndarray, K: int, every: bool) -> tuple[np.ndarray, list[dict]]:
    """(paths that go on, rows of RUNs): repeats within a batch, each chain of them checked against its source text.

    The tags of p are row numbers of the batch here; those of the results are tags of texts."""
    heads, rest, of = settle(p, every)
    source = heads[of]
    order, at = chains(rest, source)
    good = np.zeros(len(rest), bool)
    n = np.add.reduceat(rest["n"][order], at, dtype=np.int64) if len(at) else at
    for k, (a, z) in enumerate(zip(at.tolist(), np.append(at[1:], len(rest)).tolist())):
        r, s, m = rest[order[a]], source[order[a]], int(n[k]) + K - 1
        x, y = int(r["start"]), int(s["start"])
        good[order[a:z]] = units[r["tag"]].part(x, x + m) == units[s["tag"]].part(y, y + m)
    found = rest[good]
    if every:
        found = np.concatenate([found, heads[np.unique(of[good])]])
    heads["tag"] = tags[heads["tag"]]
    if not len(found):
        return heads, []
    rec = np.empty(len(found), RUN)
    rec["start"], rec["n"] = found["start"], found["n"]
    return heads, [per_document(found["doc"], tags[found["tag"]], rec, 1)]


def into_buckets(p: np.ndarray, buckets: int) -> dict:
    at = (p["key"] % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((p["start"], p["doc"], at))
    at, p = at[order], p[order]
    cuts = group_starts(at)
    none = np.zeros(len(cuts), np.int64)
    return {"bucket": at[cuts], "salt": none.astype(np.int32), "doc": none, "tag": none, "kind": none.astype(np.int32), "blob": [pack_columns(x) for x in np.split(p, cuts[1:])]}


def grouped(it, n: int) -> Iterator[tuple[tuple, list]]:
    """(values of the first n columns, the last column's values) of rows that stand together; batches are sorted by the first n."""
    now, got = None, []
    for b in it:
        for *key, blob in zip(*(c.to_pylist() for c in b.columns)):
            if key != now:
                if got:
                    yield now, got
                now, got = key, []
            got.append(blob)
    if got:
        yield now, got


def compare(p: np.ndarray, whole: bool, base: int, split: int) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """(rows, heads, key of each): what a group of paths tells; one path for each key may go on."""
    opened = np.unique(p["key"][p["many"] & OPEN > 0])
    p = p[np.lexsort((p["content"], p["key"]))]
    out = []
    if whole:
        p, rest, of = settle(p, False)
        if len(rest):
            rec = np.empty(len(rest), SPAN)
            rec["start"], rec["n"], rec["sdoc"], rec["stag"], rec["sstart"] = rest["start"], rest["n"], p["doc"][of], p["tag"][of], p["start"][of]
            out.append(per_document(rest["doc"], rest["tag"], rec, 3))
    at = group_starts(p["key"])
    size = np.diff(np.append(at, len(p)))
    more = (size > 1) | np.isin(p["key"][at], opened)
    hand = np.repeat(more, size) & (p["many"] & OPEN == 0)
    if hand.any():
        rec = np.empty(int(hand.sum()), AMBIGUOUS)
        rec["start"], rec["n"], rec["key"] = p["start"][hand], p["n"][hand], p["key"][hand]
        # paths of a key stand in hash order of their contents, so its parts are alike
        place = (np.arange(len(p)) - np.repeat(at, size)) // split
        rec["sub"] = np.where(np.repeat(size > split, size) | (base > 0), base + place + 1, 0)[hand]
        out.append(per_document(p["doc"][hand], p["tag"][hand], rec, 2))
    heads = p[at]
    heads["many"] |= np.where(more, OPEN, 0).astype(np.uint8)
    return out, heads, at


def meet(rows: DataFrame, whole: bool, tables: Tables, split: int = SPLIT, heavy: int = HEAVY) -> DataFrame:
    """Paths of rows (kind 0, deleted afterwards) compared by key: kind 2 has AMBIGUOUS paths; with `whole`, kind 3 SPANs
    of equal ones."""
    n = parts(rows.sparkSession)
    buckets = SUB * n
    own = rows.filter("kind = 0")
    # at most `buckets` rows
    sizes = own.groupBy("bucket").agg(F.ceil(F.sum(F.length("blob")) / F.lit(heavy)).cast("int").alias("k"))
    dealt = own.join(F.broadcast(sizes), "bucket").select("bucket", F.when(F.col("k") > 1, F.pmod(F.xxhash64("blob"), F.col("k")).cast("int")).otherwise(0).alias("salt"), "k", "blob")

    def together(it):
        for (bucket, salt, k), blobs in grouped(it, 3):
            final = k <= 1
            out, heads, _ = compare(np.concatenate([unpack_columns(x, PATH) for x in blobs]), whole, 0 if final else 1 + (salt << 12), split)
            yield from out
            if not final:
                sub = (heads["key"] // np.uint64(buckets) % np.uint64(k)).astype(np.int32)
                order = np.argsort(sub, kind="stable")
                cuts = group_starts(sub[order])
                none = np.zeros(len(cuts), np.int64)
                yield {"bucket": np.full(len(cuts), bucket, np.int32), "salt": sub[order][cuts], "doc": none, "tag": none, "kind": none.astype(np.int32), "blob": [pack_columns(x) for x in np.split(heads[order], cuts[1:])]}

    def last(it):
        for (_, _), blobs in grouped(it, 2):
            yield from compare(np.concatenate([unpack_columns(x, PATH) for x in blobs]), whole, 1 << 30, split)[0]

    placed = dealt.repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt").select("bucket", "salt", "k", "blob")
    first = tables.cut(arrow_map(placed, together, ROWS))
    again = first.filter("kind = 0").repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt").select("bucket", "salt", "blob")
    more = tables.cut(arrow_map(again, last, ROWS))
    tables.drop(rows, "kind=0")
    return first.filter("kind > 0").unionByName(more).select("doc", "tag", "kind", "blob")


def cut_paths(docs: DataFrame, units: Callable[[str], Units], K: int, m: int, every: bool, tables: Tables) -> DataFrame:
    """ROWS: kind 0 has the paths that go on, by bucket; kind 1 the RUNs that repeat within a batch."""
    batches(docs.sparkSession)
    buckets = SUB * parts(docs.sparkSession)

    def cut(it):
        for b in it:
            u = [units(x) for x in texts(b)]
            rows = [(d, k, x.values) for k, (d, x) in enumerate(zip(b.column(0).to_pylist(), u))]
            found = [x for x in paths(rows, K, m) if len(x)]
            if found:
                p, out = settle_batch(np.concatenate(found), u, b.column(1).to_numpy().astype(np.uint32), K, every)
                yield from out
                yield into_buckets(p, buckets)

    return tables.cut(arrow_map(documents(docs), cut, ROWS), "kind")


def with_blobs(docs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Documents with the blobs that rows have for them; inner: only those that have any."""
    return docs.join(rows.groupBy("doc", "tag").agg(F.collect_list("blob").alias("blobs")), ["doc", "tag"], how)


def sources(batch) -> Iterator[tuple[int, int, str, bytes]]:
    for d, t, x, blobs in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc", "tag", "text", "blobs"))):
        yield d, t, x, b"".join(blobs or ())
