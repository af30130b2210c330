"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set holds its distinct 5-word shingles (A-Z lower-cased).  Its sketch keeps the 1024 smallest shingle
hashes in their order, 32 bits of each; the 16 smallest are kept whole.

1. Documents with equal sets form a class; the smallest id stands for it in all that follows.
2. Inverted lists of the 16 smallest values: two sets with a similarity of s share none of the first k of their union
   with a probability of (1 - s)^k.  Lists of up to 64 classes give all their pairs.
3. Longer lists (common passages, large groups of copies) give no pairs.  A class with fewer values in short lists than
   make a missed link less likely than ODDS is listed again.  Sets within the sketch are listed under their prefix: with
   all values in one order, frequent ones last, two sets of n and m that link share a value among the first
   n - ceil(s n) + 1 and m - ceil(s m) + 1, always.  So what is rare decides, and a set whose own values fill its prefix
   meets nothing, whatever passage it shares.  Larger sets are listed under every run of consecutive values of their 192
   smallest: similar sets share a run, sets that share a passage seldom do.  The length of the runs follows from the size
   of the set and the wanted similarity, as the longest (of up to six) that the sets share but for ODDS.  These lists
   are compared whole, in blocks of bounded size, and each block gives a spanning forest of its links instead of all
   pairs.
4. Union sketches estimate each pair's similarity.  For sets within the sketch this is the true one, but for equal 32
   bits of unequal values (a chance of 2e-4 a pair at most, and of that to matter only for a pair just below the
   threshold).  For larger ones it is off by 0.0125 (one deviation): a pair must fall 0.08 below the threshold to go, and
   lie 0.08 above it to count as a link before it is confirmed.
5. Full sets confirm links.  First each class with the partner that looks best; then all pairs that the components of
   these links leave apart, so copies of one text aren't confirmed pair by pair and no link between components is lost.

ODDS is 1e-8, for a pair at the threshold; sets of fewer than a dozen shingles meet by single values, and miss with the
probability that they share none, which is 0 where they link.

A null or empty text has an empty set and links with nothing.  A null id counts as -1, and rows that share an id are
one node.  Ties go to the smallest id.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, U64, Tables, arrow_map, batches, grams, mix, texts
from .links import components, roots

SKETCH, RUNS, HEAD, LIMIT, BLOCK = 1024, 192, 16, 64, 1024
#: so many of the most frequent values are known to all tasks and go last in prefixes
KNOWN = 1 << 17
#: how often a link at the threshold may be missed by the short lists, and by the runs of large sets
ODDS = 1e-8
#: how far off an estimate from cut sketches may be, either way
OFF = 0.08


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    v = HASHES.of(text.encode("utf8", "surrogatepass").lower().split())
    return np.unique(grams(v, min(words, len(v)))) if len(v) else v


def sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(it):
        for b in it:
            out = {k: [] for k in ("n", "f", "g", "head", "sketch")}
            for t in texts(b):
                s = shingle_set(t, words)
                f = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None
                for c, x in zip(out.values(), (len(s), *((None, None) if f is None else np.array([f >> 64, f & 2**64 - 1], U64).view(np.int64).tolist()), s[:HEAD].view(np.int64), s[:SKETCH].astype(np.uint32).tobytes())):
                    c.append(x)
            yield {"doc_id": b.column(0), "doc": b.column(1)} | out

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), "text")
    return arrow_map(source, run, "doc_id long, doc long, n long, f long, g long, head array<long>, sketch binary")


def list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of short lists whose sizes allow a link."""

    def run(it):
        for b in it:
            a, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in b.column(0).to_pylist():
                d, n = (np.array([x[k] for x in row], np.int64) for k in ("doc", "n"))
                i, j = np.triu_indices(len(d), 1)
                ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (d[i] != d[j])
                a.append(np.minimum(d[i], d[j])[ok])
                c.append(np.maximum(d[i], d[j])[ok])
            yield {"a": np.concatenate(a), "b": np.concatenate(c)}

    return arrow_map(lists, run, "a long, b long").distinct()


def safe_values(percent: int) -> int:
    """So many short lists make it unlikely enough that a linked set shares none of them."""
    return min(HEAD, math.ceil(math.log(ODDS) / math.log(1 - min(percent, 99) / 100)))


@cache
def run_length(n: int, percent: int) -> int:
    """The longest run that sets of n at the threshold share but for ODDS."""
    s, trials = percent / 100, min(n, RUNS) * percent // 100
    for r in range(6, 1, -1):
        # chance of no r hits in a row: state k is k hits so far
        state = np.zeros(r)
        state[0] = 1.0
        for _ in range(trials):
            state = np.concatenate([[state.sum() * (1 - s)], state[:-1] * s])
        if state.sum() <= ODDS:
            return r
    return 1


@cache
def run_lengths(n: int, percent: int) -> frozenset[int]:
    """Lengths of the runs that a set of n is listed under: its own and those of the sizes that it may link with."""
    low, high = -(-n * percent // 100), n * 100 // percent
    return frozenset(run_length(min(k, 2 * RUNS), percent) for k in range(min(low, 2 * RUNS), min(high, 2 * RUNS) + 1))


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes that stand in more than LIMIT of the rows, at most KNOWN, in their order; and the place of each, the rarest first."""

    def run(it):
        for b in it:
            own = [codes(x, SKETCH) for x in b.column(0).to_pylist()]
            code, c = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)
            yield {"code": code, "c": c}

    counts = arrow_map(rows.select("sketch"), run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).filter(F.col("c") > LIMIT)
    got = counts.orderBy(F.desc("c"), "code").limit(KNOWN).toPandas()
    code, c = got["code"].to_numpy(np.int64), got["c"].to_numpy(np.int64)
    order = np.argsort(code)
    place = np.empty(len(code), np.int64)
    place[np.lexsort((code, c))] = np.arange(len(code))
    return code[order], place[order]


def prefix(code: np.ndarray, percent: int, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first codes of a whole set, one of which it shares with each set that it links with."""
    own = np.full(len(code), -1)
    if len(known):
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        own = np.where(known[at] == code, place[at], -1)
    return code[np.lexsort((code, own))[: len(code) - -(-percent * len(code) // 100) + 1]]


def prefix_keys(rows: DataFrame, percent: int) -> DataFrame:
    """key, doc, n of sets that their sketches hold whole."""
    known, place = frequent(rows)

    def run(it):
        for b in it:
            own = [prefix(codes(x, SKETCH), percent, known, place) for x in b.column(2).to_pylist()]
            size = [len(x) for x in own]
            yield {"key": np.concatenate([np.zeros(0, np.int64), *own]), "doc": np.repeat(b.column(0).to_numpy(), size), "n": np.repeat(b.column(1).to_numpy(), size)}

    return arrow_map(rows, run, "key long, doc long, n long")


def run_keys(rows: DataFrame, percent: int) -> DataFrame:
    """key, doc, n of sets of any size."""

    def run(it):
        for b in it:
            out = {k: [] for k in ("key", "doc", "n")}
            for d, n, sk in zip(*(b.column(k).to_pylist() for k in range(3))):
                s = np.frombuffer(sk, np.uint32)[:RUNS].astype(U64)
                for r in run_lengths(n, percent):
                    k = np.unique(mix(grams(s + U64(1), min(r, len(s))) + U64(r)).view(np.int64)).tolist()
                    for c, x in zip(out.values(), (k, [d] * len(k), [n] * len(k))):
                        c.extend(x)
            yield out

    return arrow_map(rows, run, "key long, doc long, n long")


def with_sketches(keys: DataFrame, rows: DataFrame, tables: Tables) -> DataFrame:
    """key, c (how many classes have it), doc, n, sketch; for keys of more than one."""
    listed = tables.cut(keys)
    counts = tables.cut(listed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    return tables.cut(listed.join(counts, "key")).join(rows.select("doc", "sketch"), "doc")


def long_pairs(rows: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Pairs that leave no two linked classes of rows (doc, n, sketch) apart: of two whole sets by prefixes, of others by runs."""
    whole = rows.filter(F.col("n") <= SKETCH)
    large = rows.filter(100 * F.col("n") > percent * SKETCH)
    lists = [with_sketches(prefix_keys(whole, percent), whole, tables)]
    if large.filter(F.col("n") > SKETCH).limit(1).count():
        lists.append(with_sketches(run_keys(large, percent), large, tables))
    found = [block_pairs(x, percent) for x in lists]
    return found[0] if len(found) < 2 else found[0].unionByName(found[1])


def codes(sketch: bytes, most: int) -> np.ndarray:
    """The first values of a sketch, made distinct by counting equal ones."""
    x = np.sort(np.frombuffer(sketch, np.uint32)[:most]).astype(np.int64)
    if len(x):
        new = np.concatenate([[True], x[1:] != x[:-1]])
        at = np.flatnonzero(new)
        x += (np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))).astype(np.int64) << 32
    return x


def similarity(shared, n, m):
    """Of sets of n and m from what their sketches share: of the part of the values that both sketches reach."""
    large = np.maximum(n, m)
    scale = np.minimum(SKETCH, large) / large
    return shared / np.maximum((n + m) * scale - shared, 1e-9)


def least(n, m, percent):
    return np.where(np.maximum(n, m) <= SKETCH, percent / 100 - 1e-9, percent / 100 - OFF)


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many codes each of x shares with each of y, by products of bounded 0/1 matrices over codes that stand twice."""
    own = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    code, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    left = own < len(x)
    column = np.full(len(code), -1)
    both = np.flatnonzero((np.bincount(at[left], minlength=len(code)) > 0) & (np.bincount(at[~left], minlength=len(code)) > 0))
    column[both] = np.arange(len(both))
    where = column[at]
    out = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, len(both), 2048):
        m = np.zeros((len(x) + len(y), min(2048, len(both) - a)), np.float32)
        ok = (where >= a) & (where < a + m.shape[1])
        m[own[ok], where[ok] - a] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


def forest(sim: np.ndarray, sure: np.ndarray, maybe: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the sure pairs, and the other pairs between its trees."""
    nodes = np.unique(np.concatenate([a, b]))
    i, j = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    root, x, y = np.arange(len(nodes)), [], []
    while True:
        new = sure & (root[i][:, None] != root[j])
        if not new.any():
            break
        best = np.where(new, sim, -1.0)
        r, c = np.arange(len(a)), best.argmax(1)
        r, c = r[best[r, c] > 0], c[best[r, c] > 0]
        x.append(a[r])
        y.append(b[c])
        u, v = roots(np.concatenate([root[i[r]], root]), np.concatenate([root[j[c]], np.arange(len(nodes))]))
        root = v[np.searchsorted(u, root)]
    r, c = np.nonzero(maybe & (root[i][:, None] != root[j]))
    x, y = np.concatenate([*x, a[r]]), np.concatenate([*y, b[c]])
    return np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64)


def block_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of the lists that leave no two classes apart whose sketches allow a link."""
    rows = lists.withColumn("k", F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    grouped = rows.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("doc", "n", "sketch", (F.col("own") > F.col("other")).alias("right"))).alias("rows"))

    def run(it):
        for b in it:
            out = [(np.zeros(0, np.int64),) * 2]
            for i, j, rows in zip(*(c.to_pylist() for c in b.columns)):
                d, n = (np.array([x[k] for x in rows], np.int64) for k in ("doc", "n"))
                s = [codes(x["sketch"], SKETCH) for x in rows]
                right = np.array([x["right"] for x in rows])
                # a block meets itself in its own group only
                l, r = (np.arange(len(rows)),) * 2 if i == j else (np.flatnonzero(~right), np.flatnonzero(right))
                if not len(l) or not len(r) or len(rows) < 2:
                    continue
                shared = shared_counts([s[k] for k in l], [s[k] for k in r])
                x, y = n[l][:, None], n[r]
                sim = similarity(shared, x, y)
                maybe = (sim >= least(x, y, percent)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (d[l][:, None] != d[r])
                sure = maybe & ((np.maximum(x, y) <= SKETCH) | (sim >= percent / 100 + OFF))
                out.append(forest(sim, sure, maybe, d[l], d[r]))
            a, c = np.unique(np.stack([np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])]), axis=1)
            yield {"a": a, "b": c}

    return arrow_map(grouped.select("i", "j", "rows"), run, "a long, b long").distinct()


def estimate(pairs: DataFrame, sk: DataFrame, percent: int) -> DataFrame:
    """a, b, est of the pairs that may link."""
    both = pairs.join(sk.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(sk.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")

    def run(it):
        for b in it:
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            shared = np.zeros(len(n))
            for k, (sa, sb) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                u = np.concatenate([codes(sa, SKETCH), codes(sb, SKETCH)])
                u.sort()
                shared[k] = (u[1:] == u[:-1]).sum()
            est = similarity(shared, n, m)
            ok = est >= least(n, m, percent)
            yield {"a": b.column(0).filter(pa.array(ok)), "b": b.column(1).filter(pa.array(ok)), "est": est[ok]}

    return arrow_map(both.select("a", "b", "na", "nb", "sa", "sb"), run, "a long, b long, est double")


def full_sets(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), "text").join(wanted, "doc", "left_semi")
    return arrow_map(source, lambda it: ({"doc": b.column(0), "s": [shingle_set(t, words).tobytes() for t in texts(b)]} for b in it), "doc long, s binary")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Links among pairs, by full sets."""
    both = pairs.select("a", "b").join(sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")

    def run(it):
        for b in it:
            ok = []
            for sa, sb in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                u = np.concatenate([np.frombuffer(sa, U64), np.frombuffer(sb, U64)])
                u.sort()
                shared = int((u[1:] == u[:-1]).sum())
                ok.append(100 * shared >= percent * (len(u) - shared))
            yield {"a": b.column(0), "b": b.column(1), "ok": ok}

    return tables.cut(arrow_map(both.select("a", "b", "sa", "sb"), run, "a long, b long, ok boolean").filter("ok").select("a", "b"))


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs between different components."""
    x, y = (found.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    batches(docs.sparkSession)
    tables = Tables(docs.sparkSession, "minhash")
    sk = tables.cut(sketches(docs, words))
    classes = tables.cut(sk.filter("n > 0").groupBy("f", "g").agg(F.min("doc").alias("rep"), F.count("*").alias("c")).filter("c > 1").select("f", "g", "rep"))
    copies = classes.withColumnsRenamed({"f": "cf", "g": "cg"})
    # not the class's first: an anti-join would need the rep of each row, so rows of no class pass and others are compared
    member = tables.cut(sk.select("doc_id", "doc", "n", "f", "g").join(copies, (F.col("f") == F.col("cf")) & (F.col("g") == F.col("cg")), "left").select("doc_id", "doc", "n", F.coalesce("rep", "doc").alias("rep")))
    others = member.filter("doc != rep").select("doc").distinct()
    reps = tables.cut(sk.filter("n > 0").select("doc", "n", "head").join(others, "doc", "left_anti"))
    heads = reps.select("doc", "n", F.explode("head").alias("value"))
    counts = tables.cut(heads.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1"))
    listed = tables.cut(heads.join(counts, "value"))
    short = list_pairs(listed.filter(F.col("c") <= LIMIT).groupBy("value").agg(F.collect_list(F.struct("doc", "n")).alias("rows")).select("rows"), percent)
    # classes that short lists alone don't cover
    long_ = listed.filter(F.col("c") > LIMIT).groupBy("doc").agg(F.count("*").alias("long"))
    open_ = tables.cut(reps.join(long_, "doc").filter(F.size("head") - F.col("long") < safe_values(percent)).select("doc"))
    # written before sketches are fetched, so their number is known and few of them leave the sketches where they are
    open_ = tables.cut(sk.select("doc", "n", "sketch").join(open_, "doc", "left_semi"))
    pairs = tables.cut(short.unionByName(long_pairs(open_, percent, tables)).distinct())
    # sketches move once, to those that have a pair
    ends = tables.cut(ends_of(pairs))
    near = tables.cut(sk.select("doc", "n", "sketch").join(ends, "doc", "left_semi"))
    tables.keep(member, pairs, near)
    pairs = tables.cut(estimate(pairs, near, percent))
    tables.drop(near)
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "est").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "est"))
    best = ends.groupBy("x").agg(F.max(F.struct("est", (-F.col("y")).alias("y"))).alias("m")).select(F.least("x", -F.col("m.y")).alias("a"), F.greatest("x", -F.col("m.y")).alias("b")).distinct()
    best = tables.cut(best)
    sets = tables.cut(full_sets(ends_of(pairs), docs, words))
    links = confirm(best, sets, percent, tables)
    rest = tables.cut(apart(pairs.select("a", "b"), components(links, tables)).join(best, ["a", "b"], "left_anti"))
    found = tables.cut(components(links.unionByName(confirm(rest, sets, percent, tables)), tables))
    tables.keep(member, found)
    return member.join(found, member["rep"] == found["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"), (F.col("doc") == F.coalesce("root", "rep")).alias("kept"))
