"""Substring dedup over words: a de Bruijn graph of word k-mers, compacted, with later copies of long spans removed.

1. Every window of K words is an edge between the nodes of its first and its last K - 1 words.  Edges leave the tasks as
   super-k-mers, runs of edges that share their smallest gram (superkmers.py, repeats.py), so equal edges meet.
2. Equal super-k-mers repeat as wholes.  Where super-k-mers of one key differ, the graph branches; their edges alone are
   looked up at their source coordinates and meet one by one, on two independent 64-bit hashes.  Either way a repeated
   edge carries the coordinates of an earlier one: a copy's path runs along its source's.
3. Compaction: the repeated edges along one pair of copy and source have nodes between them.  A node that one of them
   enters and one leaves doesn't branch and goes; what is left is where paths begin and end, and a join pairs these.
4. Verification: each path's words are read again at its source coordinates, and their 128-bit digest is joined to the
   copy, which removes the path only where its own words give the same.  (Repeats within one Arrow batch are compared
   with their source text directly.)

An edge whose word sequence also starts earlier (smaller id, or the same id and an earlier start) is repeated, and the
words that repeated edges cover go.  Windows are judged on the input.

A null or empty text, or one shorter than K words, loses nothing.  A null id counts as -1.  Rows that share an id are
judged by (id, start) alone: equal places of equal ids don't repeat each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, U64, Tables, arrow_map, batches, grams, mix, parts
from .repeats import AMBIGUOUS, HEAVY, ROWS, RUN, SPAN, SUB, Units, cut_paths, documents, into_buckets, meet, settle_batch, sources, with_blobs
from .superkmers import PATH, join_runs

GRAM = 8
COPY, SOURCE = ("doc", "tag", "start"), ("sdoc", "stag", "sstart")


def word_units(text: str) -> Units:
    words = text.encode("utf8", "surrogatepass").split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int32, len(words)) + 1, dtype=np.int32) - 1
    return Units(HASHES.of(words), b" ".join(words), ends)


def digest(part: bytes) -> np.ndarray:
    h = xxhash.xxh3_128_intdigest(part)
    return np.array([h >> 64, h & 2**64 - 1], U64).view(np.int64)


def branching_edges(docs: DataFrame, found: DataFrame, K: int, tables: Tables) -> DataFrame:
    """ROWS of the single edges of super-k-mers that were handed on."""
    buckets = SUB * parts(docs.sparkSession)

    def edges(it):
        for b in it:
            units, got, tags = [], [], []
            for k, (doc, tag, text, blob) in enumerate(sources(b)):
                rec, u = np.frombuffer(blob, AMBIGUOUS), word_units(text)
                units.append(u)
                tags.append(tag)
                h, h2 = grams(u.values, K), grams(mix(u.values ^ U64(0x5851F42D4C957F2D)), K)
                n = rec["n"].astype(np.int64)
                at = np.arange(n.sum()) + np.repeat(rec["start"] - (np.cumsum(n) - n), n)
                e = np.zeros(len(at), PATH)
                e["key"], e["content"], e["doc"], e["tag"], e["start"], e["n"] = h[at], h2[at], doc, k, at, 1
                got.append(e)
            if got:
                p, out = settle_batch(np.concatenate(got), units, np.array(tags, np.uint32), K, False)
                yield from out
                yield into_buckets(p, buckets)

    return tables.cut(arrow_map(with_blobs(documents(docs), found.filter("kind = 2")), edges, ROWS), "kind")


def span_rows(rows: DataFrame) -> DataFrame:
    """One row for each SPAN: n windows of a copy from start on, and where they stand earlier."""

    def run(it):
        for b in it:
            blobs = b.column(2).to_pylist()
            rec = np.frombuffer(b"".join(blobs), SPAN)
            n = np.array([len(x) // SPAN.itemsize for x in blobs])
            yield {"doc": np.repeat(b.column(0).to_numpy(), n), "tag": np.repeat(b.column(1).to_numpy(), n)} | {c: rec[c].astype(np.int64) for c in SPAN.names}

    return arrow_map(rows.select("doc", "tag", "blob"), run, "doc long, tag long, start int, n int, sdoc long, stag long, sstart int")


def compacted(spans: DataFrame) -> DataFrame:
    """Spans joined where one ends and the next begins, for the copy and for the source: nodes of one way in and one way out go."""
    along = ["doc", "tag", "sdoc", "stag", "shift"]
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(True).alias("leaves")), F.struct((F.col("start") + F.col("n")).alias("at"), F.lit(False).alias("leaves")))
    nodes = spans.withColumn("shift", F.col("sstart") - F.col("start")).select(*along, F.explode(ends).alias("e")).select(*along, "e.*")
    degrees = nodes.groupBy(*along, "at").agg(F.max("leaves").alias("out"), F.max(~F.col("leaves")).alias("in"))
    open_ = degrees.filter("out != in")
    # begins and ends alternate along a pair; at most one text's places meet here
    paired = open_.groupBy(*along).agg(F.array_sort(F.collect_list(F.when(F.col("out"), F.col("at")))).alias("x"), F.array_sort(F.collect_list(F.when(F.col("in"), F.col("at")))).alias("y"))
    path = F.explode(F.arrays_zip("x", "y")).alias("p")
    return paired.select(*along, path).select("doc", "tag", F.col("p.x").alias("start"), (F.col("p.y") - F.col("p.x")).alias("n"), "sdoc", "stag", (F.col("p.x") + F.col("shift")).alias("sstart"))


def with_digests(docs: DataFrame, spans: DataFrame, K: int) -> DataFrame:
    """doc, tag, start, n, hi, lo: the spans with the digest of their words at the source."""
    wanted = spans.select(F.col("sdoc").alias("doc"), F.col("stag").alias("tag"), F.col("sstart").alias("start"), "n").distinct()
    wanted = wanted.groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))

    def read(it):
        for b in it:
            out = {k: [] for k in ("sdoc", "stag", "sstart", "n", "hi", "lo")}
            for doc, tag, text, starts, ns in zip(*(c.to_pylist() for c in b.columns)):
                u = word_units(text)
                for s, n in zip(starts, ns):
                    for c, v in zip(out.values(), (doc, tag, s, n, *digest(u.part(s, s + n + K - 1)).tolist())):
                        c.append(v)
            yield out

    source = documents(docs).join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "starts", "ns")
    have = arrow_map(source, read, "sdoc long, stag long, sstart int, n int, hi long, lo long")
    # rows of one id and text say the same
    have = have.groupBy("sdoc", "stag", "sstart", "n").agg(F.max(F.struct("hi", "lo")).alias("d"))
    return spans.join(have, ["sdoc", "stag", "sstart", "n"]).select("doc", "tag", "start", "n", "d.hi", "d.lo")


def remove_repeats(docs: DataFrame, K: int = 20, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the kept words joined by spaces) and spans, the removed word ranges."""
    batches(docs.sparkSession)
    tables = Tables(docs.sparkSession, "debruijn")
    rows = cut_paths(docs, word_units, K, gram, False, tables)
    found = meet(rows, True, tables, heavy=heavy)
    edges = branching_edges(docs, found, K, tables)
    more = meet(edges, True, tables, heavy=heavy)
    spans = tables.cut(compacted(span_rows(found.filter("kind = 3").unionByName(more.filter("kind = 3")))))
    checks = with_digests(docs, spans, K).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n", "hi", "lo")).alias("checks"))
    ready = rows.filter("kind = 1").unionByName(edges.filter("kind = 1"))
    source = with_blobs(documents(docs, F.col("doc_id").cast("long").alias("doc_id")), ready, "left").join(checks, ["doc", "tag"], "left")

    def cut(it):
        for b in it:
            out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept", "spans")}
            for (_, _, text, blob), todo in zip(sources(b), b.column(b.schema.get_field_index("checks")).to_pylist()):
                words = text.encode("utf8", "surrogatepass").split()
                rec = np.frombuffer(blob, RUN)
                if todo:
                    u = word_units(text)
                    same = [(c["start"], c["n"]) for c in todo if digest(u.part(c["start"], c["start"] + c["n"] + K - 1)).tolist() == [c["hi"], c["lo"]]]
                    rec = np.concatenate([rec, np.array(same, RUN)])
                at, kept, spans = 0, [], []
                for x, y in join_runs(rec["start"], rec["n"], K - 1):
                    kept += words[at:x]
                    spans.append([x, y])
                    at = y
                line = b" ".join(kept + words[at:])
                for c, v in zip(out.values(), (len(words), sum(y - x for x, y in spans), hashlib.sha256(line).hexdigest(), line.decode("utf8", "replace"), spans)):
                    c.append(v)
            yield {"doc_id": b.column(b.schema.get_field_index("doc_id"))} | out

    return arrow_map(source.select("doc", "tag", "doc_id", "text", "blobs", "checks"), cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<array<long>>")
