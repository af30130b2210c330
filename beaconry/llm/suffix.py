"""Suffix-array dedup: every byte of a 200-byte string that stands in the corpus twice is removed.

1. Super-k-mers (repeats.py) leave out what cannot repeat: places whose smallest 32-byte gram stands nowhere else.
   Within one Arrow batch, pieces that are equal byte for byte are settled at once and one of them goes on.
2. All other pieces are dealt to shards by key, so strings that could be equal meet.  Whole keys fill a shard up to a
   bound in bytes.  Equal pieces of a shard are one text; a shard sorts all suffixes of its texts: first by seven bytes,
   then by Larsson-Sadakane refinement, which doubles the compared length and touches unsorted groups alone.  Common
   prefixes follow Kasai's rule, PLCP[i] >= PLCP[i-1] - 1: only positions whose left neighbours differ are compared, the
   rest is a running maximum.  A common prefix of the wanted length marks both places.
3. A key with very many pieces is dealt to several shards.  Each gives its distinct strings, in order of a 128-bit
   fingerprint; they are sent on by binary search among splitters, and shards are merged by binary search there.

A null text counts as empty, texts below the length lose nothing.  Matches never cross rows; equal rows are two places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Tables, arrow_map, batches, grams, group_starts, mix, parts
from .repeats import AMBIGUOUS, HEAVY, RUN, SPLIT, SUB, Units, cut_paths, documents, grouped, meet, per_document, sources, with_blobs
from .superkmers import join_runs

GRAM = 32
HEAD = 7
#: bytes of a shard; the last key may go beyond by SPLIT pieces
SHARD = 1 << 20
PLACE = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<i4")])


CODES = mix(np.arange(256, dtype=U64) + U64(0x9E3779B97F4A7C15))


def byte_units(text: str) -> Units:
    raw = text.encode("utf8", "surrogatepass")
    return Units(CODES[np.frombuffer(raw, np.uint8)], raw)


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted suffixes of concatenated pieces (uint8), each ending at its piece's end; equal ones by their place."""
    n = len(text)
    left = (np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n)).astype(np.int32)
    key = np.zeros(n, np.int64)
    wide = np.concatenate([text.astype(np.int64) + 1, np.zeros(HEAD, np.int64)])
    for k in range(HEAD):
        key = (key << 9) | np.where(left > k, wide[k : k + n], 0)
    sa = np.argsort(key, kind="stable").astype(np.int32)
    rank = np.empty(n, np.int32)
    sorted_ = key[sa]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if n else np.zeros(0, bool)
    del key, wide, sorted_
    starts = np.flatnonzero(first)
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    h = HEAD
    size = np.diff(np.append(starts, n))
    open_ = np.flatnonzero(np.repeat(size > 1, size)).astype(np.int32)
    while len(open_):
        i = sa[open_]
        # past the end of a piece: below all others, and in order of places
        nxt = np.where(left[i] > h, rank[np.minimum(i + h, n - 1)], i - n)
        group = rank[i]
        order = np.lexsort((nxt, group))
        i, group, nxt = i[order], group[order], nxt[order]
        sa[open_] = i
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(i)))
        rank[i] = np.repeat(open_[at], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in sa with the one in front of it."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    piece = np.searchsorted(ends, np.arange(n), side="right")
    left = ends[piece] - np.arange(n)
    front = np.full(n, -1)
    front[sa[1:]] = sa[:-1]
    start = np.concatenate([[0], ends[:-1]])[piece] == np.arange(n)
    before = np.concatenate([[0], text[:-1]])
    # left neighbours agree: the value follows from the place on the left
    follows = (front >= 0) & ~start & ~start[front] & (before == before[front])
    i = np.flatnonzero((front >= 0) & ~follows)
    j, lcp = front[i], np.zeros(len(i), np.int64)
    most = np.minimum(left[i], left[j])
    live = np.arange(len(i))
    while len(live):
        more = lcp[live] < most[live]
        live = live[more]
        live = live[text[i[live] + lcp[live]] == text[j[live] + lcp[live]]]
        lcp[live] += 1
    plcp = np.zeros(n, np.int64)
    plcp[i] = lcp + i
    plcp = np.maximum.accumulate(plcp) - np.arange(n)
    plcp[front < 0] = 0
    return plcp[sa]


def repeated_places(text: np.ndarray, ends: np.ndarray, K: int) -> tuple[np.ndarray, np.ndarray]:
    """(which places start K bytes that stand twice among the pieces, a group number for each place: equal for equal strings)."""
    sa = suffix_array(text, ends)
    same = common_prefixes(text, ends, sa) >= K
    twice = same.copy()
    twice[:-1] |= same[1:]
    marked, group = np.zeros(len(text), bool), np.empty(len(text), np.int32)
    marked[sa] = twice
    group[sa] = np.cumsum(~same)
    return marked, group


def shard_rows(docs: DataFrame, found: DataFrame, K: int) -> DataFrame:
    """One row for each piece that needs comparing; slot is the same for pieces of one key and part of it."""

    def pieces(it):
        for b in it:
            out = {k: [] for k in ("slot", "doc", "tag", "start", "n", "split")}
            raw = []
            for doc, tag, text, blob in sources(b):
                data = text.encode("utf8", "surrogatepass")
                rec = np.frombuffer(blob, AMBIGUOUS)
                slot = mix(rec["key"] + rec["sub"].astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
                for c, v in zip(out.values(), (slot, np.full(len(rec), doc), np.full(len(rec), tag), rec["start"], rec["n"], rec["sub"] > 0)):
                    c.append(v)
                raw += [data[s : s + z] for s, z in zip(rec["start"].tolist(), (rec["n"] + K - 1).tolist())]
            if raw:
                yield {k: np.concatenate(v) for k, v in out.items()} | {"piece": raw}

    return arrow_map(with_blobs(documents(docs), found.filter("kind = 2")), pieces, "slot long, doc long, tag long, start int, n int, split boolean, piece binary")


def shards(it, bound: int):
    """(doc, tag, start, n, split, pieces) of runs of whole slots, each run of bounded size; rows are sorted by slot."""
    cols, raw, slots, size = [], [], [], 0

    def cut(at):
        nonlocal cols, raw, slots, size
        flat = [np.concatenate(c) for c in zip(*cols)]
        out = (*(c[:at] for c in flat), raw[:at])
        cols, raw, slots = [tuple(c[at:] for c in flat)], raw[at:], slots[at:]
        size = sum(map(len, raw))
        return out

    for b in it:
        s, *rest = (b.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        cols.append(tuple(rest))
        raw += b.column(6).to_pylist()
        slots += s.tolist()
        size += sum(map(len, raw[-len(s) :]))
        while size >= bound:
            # the fewest whole slots that reach the bound; the last slot may go on in the next batch
            at = int(np.searchsorted(np.cumsum(list(map(len, raw))), bound)) + 1
            while at < len(slots) and slots[at] == slots[at - 1]:
                at += 1
            if at >= len(slots):
                break
            yield cut(at)
    if raw:
        yield cut(len(raw))


def compare_shards(rows: DataFrame, K: int, bound: int = SHARD) -> DataFrame:
    """kind 1: RUNs of places that repeat within a shard; kind 3: sorted PLACEs of split keys, by part of the fingerprints."""
    n = parts(rows.sparkSession)
    merges = SUB * n
    splitters = (np.arange(1, merges, dtype=np.float64) * (2.0**64 / merges)).astype(U64)

    def compare(it):
        for doc, tag, start, windows, split, pieces in shards(it, bound):
            index: dict[bytes, int] = {}
            of = np.array([index.setdefault(x, len(index)) for x in pieces])
            one = np.full(len(index), len(of))
            np.minimum.at(one, of, np.arange(len(of)))
            text = np.frombuffer(b"".join(index), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, index), np.int64, len(index)))
            begin, fit = np.append(0, ends[:-1]), windows[one].astype(np.int64)
            twice, group = repeated_places(text, ends, K)
            # texts that stand twice repeat as wholes
            many = np.flatnonzero(np.bincount(of) > 1)
            twice[np.arange(fit[many].sum()) + np.repeat(begin[many] - (np.cumsum(fit[many]) - fit[many]), fit[many])] = True
            edge = np.flatnonzero(np.diff(np.concatenate([[0], twice.view(np.int8), [0]])))
            x, y = edge[::2], edge[1::2]
            own = np.searchsorted(ends, x, side="right")
            count = np.bincount(own, minlength=len(index))
            first = np.cumsum(count) - count
            # the runs of each text, for every piece that it is
            c = count[of]
            if c.any():
                piece = np.repeat(np.arange(len(of)), c)
                run = np.arange(c.sum()) + np.repeat(first[of] - (np.cumsum(c) - c), c)
                rec = np.empty(len(run), RUN)
                rec["start"], rec["n"] = start[piece] + (x - begin[own])[run], (y - x)[run]
                out = per_document(doc[piece], tag[piece].astype(np.uint32), rec, 1)
                yield out | {"part": np.zeros(len(out["doc"]), np.int32)}
            if split.any():
                v = CODES[text]
                a, b2 = grams(v, K), grams(mix(v ^ U64(0x5851F42D4C957F2D)), K)
                t = np.flatnonzero(split[one])
                places = np.arange(fit[t].sum()) + np.repeat(begin[t] - (np.cumsum(fit[t]) - fit[t]), fit[t])
                _, single = np.unique(group[places], return_index=True)
                places = places[single]
                own = np.searchsorted(ends, places, side="right")
                p = np.empty(len(places), PLACE)
                p["a"], p["b"], p["doc"], p["tag"], p["start"] = a[places], b2[places], doc[one[own]], tag[one[own]], start[one[own]] + places - begin[own]
                p = p[np.lexsort((p["b"], p["a"]))]
                cuts = np.searchsorted(p["a"], splitters, side="right")
                found = [(k, z.tobytes()) for k, z in enumerate(np.split(p, cuts)) if len(z)]
                none = np.zeros(len(found), np.int64)
                yield {"doc": none, "tag": none, "kind": np.full(len(found), 3, np.int32), "blob": [z for _, z in found], "part": np.array([k for k, _ in found], np.int32)}

    placed = rows.repartition(n, "slot").sortWithinPartitions("slot").select("slot", "doc", "tag", "start", "n", "split", "piece")
    return arrow_map(placed, compare, "doc long, tag long, kind int, blob binary, part int")


def merge_shards(rows: DataFrame) -> DataFrame:
    """RUNs of places whose string stands in another shard of their key too."""

    def merge(it):
        for _, blobs in grouped(it, 1):
            lists = sorted((np.frombuffer(x, PLACE) for x in blobs), key=len)
            hit = [np.zeros(len(x), bool) for x in lists]
            have = np.zeros(0, PLACE)
            for x, h in zip(lists, hit):
                # binary search of the new shard's strings among the merged ones
                at = np.searchsorted(have["a"], x["a"])
                h |= (at < len(have)) & (have["a"][np.minimum(at, len(have) - 1)] == x["a"]) & (have["b"][np.minimum(at, len(have) - 1)] == x["b"]) if len(have) else False
                have = np.concatenate([have, x[~h]])
                have = have[np.argsort(have["a"], kind="stable")]
            every = np.concatenate([x[h] for x, h in zip(lists, hit)])
            twice = np.unique(every["a"])
            for x in lists:
                at = np.searchsorted(twice, x["a"])
                p = x[(at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == x["a"])] if len(twice) else x[:0]
                if len(p):
                    rec = np.empty(len(p), RUN)
                    rec["start"], rec["n"] = p["start"], 1
                    yield per_document(p["doc"], p["tag"], rec, 1)

    placed = rows.filter("kind = 3").repartition(parts(rows.sparkSession), "part").sortWithinPartitions("part").select("part", "blob")
    return arrow_map(placed, merge, "doc long, tag long, kind int, blob binary")


def repeated_runs(docs: DataFrame, K: int, tables: Tables, split: int = SPLIT, heavy: int = HEAVY, bound: int = SHARD) -> DataFrame:
    """doc, tag, blob: RUNs of K-byte strings that stand elsewhere too."""
    rows = cut_paths(docs, byte_units, K, min(GRAM, K), True, tables)
    found = meet(rows, False, tables, split, heavy)
    compared = tables.cut(compare_shards(shard_rows(docs, found, K), K, bound))
    found_ = [rows.filter("kind = 1").select("doc", "tag", "blob"), compared.filter("kind = 1").select("doc", "tag", "blob"), merge_shards(compared).select("doc", "tag", "blob")]
    return found_[0].unionByName(found_[1]).unionByName(found_[2])


def kept_ranges(rec: np.ndarray, size: int, K: int) -> list[tuple[int, int]]:
    at, out = 0, []
    for x, y in join_runs(rec["start"], rec["n"], K - 1):
        if x > at:
            out.append((at, x))
        at = y
    return out + [(at, size)] if at < size else out


def remove_repeats(docs: DataFrame, K: int = 200, keep_text: bool = False, split: int = SPLIT, heavy: int = HEAVY, bound: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text the row's own columns and its remaining text.

    In the text, characters of which a part was removed go as a whole."""
    batches(docs.sparkSession)
    runs = repeated_runs(docs, K, Tables(docs.sparkSession, "suffix"), split, heavy, bound)
    own = [c for c in docs.columns if c not in ("text", "doc", "tag", "blobs")] if keep_text else ["doc_id"]
    kinds = dict(docs.dtypes)
    cols = [F.col(f"`{c}`") for c in own] if keep_text else [F.col("doc_id").cast("long").alias("doc_id")]

    def cut(it):
        for b in it:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text")}
            for _, _, text, blob in sources(b):
                data = text.encode("utf8", "surrogatepass")
                keep = kept_ranges(np.frombuffer(blob, RUN), len(data), K)
                kept = [data[x:y] for x, y in keep]
                spans = sum(y < len(data) for _, y in keep) + (bool(data) and (not keep or keep[0][0] > 0))
                new = text if not blob else "".join(x.decode("utf8", "ignore") for x in kept) if keep_text else None
                for c, v in zip(out.values(), (len(data), len(data) - sum(map(len, kept)), spans, hashlib.sha256(b"".join(kept)).hexdigest(), new)):
                    c.append(v)
            out = {k: pa.array(v) if k in ("kept_sha256",) else v for k, v in out.items()}
            yield {c: b.column(b.schema.get_field_index(c)) for c in own} | out

    schema = ", ".join(f"`{c}` {kinds[c] if keep_text else 'long'}" for c in own)
    more = ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text
    return arrow_map(with_blobs(documents(docs, *cols), runs, "left"), cut, schema + more)
