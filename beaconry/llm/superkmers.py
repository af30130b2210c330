"""Compacted window paths: runs of consecutive windows that share their smallest gram.

A window is K consecutive values (word hashes, or byte codes).  The smallest hash among the window's m-grams is its
key, so equal windows have equal keys at equal places.  Consecutive windows with the same gram form one path, an
edge run of the de Bruijn graph without branches; its key and a hash of the values it spans describe it.  Every
window lies in exactly one path, and a path takes the place of about (K - m + 1) / 2 windows in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import U64, grams, mix

CHUNK = 1 << 17
PATH = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<i4"), ("n", "<u2"), ("many", "u1")])
_P = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_P, pow(_P, -1, 2**64)):
            with np.errstate(over="ignore"):
                _POWERS.append(np.cumprod(np.concatenate([np.ones(1, U64), np.full(2 * CHUNK, base, U64)])))
    return _POWERS[0], _POWERS[1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w, by doubling."""
    n, size = len(x) - w + 1, 1
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n]) if w > size else x[:n]


def paths(docs: list[tuple[int, int, np.ndarray]], K: int, m: int) -> Iterator[np.ndarray]:
    """PATH rows of (id, tag, values) documents; shorter ones than K have none.  Works through bounded chunks."""
    group, total = [], 0
    for doc, tag, v in docs:
        windows = len(v) - K + 1
        for a in range(0, windows, CHUNK - K):
            piece = v[a : min(a + CHUNK - K, windows) + K - 1]
            if total + len(piece) > CHUNK:
                yield chunk_paths(group, K, m)
                group, total = [], 0
            group.append((doc, tag, a, piece))
            total += len(piece)
    if group:
        yield chunk_paths(group, K, m)


def chunk_paths(group: list[tuple[int, int, int, np.ndarray]], K: int, m: int) -> np.ndarray:
    docs, tags, offsets, pieces = zip(*group)
    v = np.concatenate(pieces) if len(pieces) > 1 else pieces[0]
    lens = np.array([len(x) for x in pieces])
    ends = np.cumsum(lens)
    g = grams(v, m)
    index = np.arange(len(g), dtype=U64)
    best = sliding_min((g & ~U64(0xFFFFFF)) | index, K - m + 1)
    owner = np.repeat(np.arange(len(lens)), lens)[: len(best)]
    at = np.flatnonzero(np.arange(len(best)) + K <= ends[owner])
    pos = (best[at] & U64(0xFFFFFF)).astype(np.int64)
    # a gram never spans two documents here, but neighbouring windows of two documents are not one path
    first = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else at
    n = np.diff(np.append(first, len(at)))
    s, own = at[first], owner[at[first]]
    up, down = powers()
    prefix = np.zeros(len(v) + 1, U64)
    np.cumsum(v * up[: len(v)], out=prefix[1:])
    out = np.empty(len(s), PATH)
    out["key"] = g[pos[first]] if len(first) else 0
    out["content"] = mix((prefix[s + n + K - 1] - prefix[s]) * down[s] + n.astype(U64))
    out["doc"] = np.array(docs, np.int64)[own]
    out["tag"] = np.array(tags, np.uint32)[own]
    out["start"] = s - (ends - lens)[own] + np.array(offsets)[own]
    out["n"] = n
    out["many"] = 0
    return out


def join_runs(start: np.ndarray, n: np.ndarray, more: int) -> list[tuple[int, int]]:
    """Runs of n windows made [from, to) ranges of the values they cover (more past the last start), touching ones one."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start = start[order]
    reach = np.maximum.accumulate(start + n[order] + more)
    at = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return list(zip(start[at].tolist(), reach[np.append(at[1:], len(start)) - 1].tolist()))
