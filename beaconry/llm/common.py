"""Helpers shared by the operators: shared-folder tables, Arrow mapping, word hashing and packed blobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, shared_dir

U64 = np.uint64


class Tables:
    """Intermediate tables in the shared folder.  cut() writes and rereads (lineage ends there); drop() and keep() delete."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame, *by: str) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        out._beaconry_path = path
        return out

    def drop(self, df: DataFrame, part: str = "") -> None:
        """Only for a table (or part of one) from which nothing unwritten still derives."""
        delete(self.spark, f"{df._beaconry_path}/{part}")

    def keep(self, *dfs: DataFrame) -> None:
        """Deletes all tables but these; only where nothing unwritten derives from the others."""
        for k in range(self.n):
            if f"{self.root}/{k}" not in {df._beaconry_path for df in dfs}:
                delete(self.spark, f"{self.root}/{k}")


def batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the Arrow batches that Python operators get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, func: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow with func yielding dicts of columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(it):
        for cols in func(it):
            out = [c if isinstance(c, pa.Array) else pa.array(c, arrow.field(k).type) for k, c in ((f.name, cols[f.name]) for f in arrow)]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(col)).to_pylist()]


def ids(batch: pa.RecordBatch, col: str = "doc_id") -> np.ndarray:
    c = batch.column(batch.schema.get_field_index(col))
    return c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered up to a bound."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


HASHES = WordHashes()


def grams(v: np.ndarray, m: int) -> np.ndarray:
    """Hash of each run of m consecutive values: order-sensitive, by doubling; len(v) - m + 1 of them."""
    if len(v) < m:
        return v[:0]
    mult, out, have, size, h, p = 0x9E3779B97F4A7C15, None, 0, 1, v, 0x9E3779B97F4A7C15
    while True:
        if m & size:
            out = h.copy() if out is None else out[: len(out) - size] * U64(p) + h[have : have + len(out) - size]
            have += size
        size, old, p = size * 2, p, p * p % 2**64
        if size > m:
            return mix(out[: len(v) - m + 1])
        h = h[: len(h) - size // 2] * U64(old) + h[size // 2 :]


def group_starts(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start, in sorted columns."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
