"""A training-corpus pipeline over `documents`: quality, near-duplicates, repeated substrings, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of
`documents`.  The first, second and fourth drop documents; the third cuts repeated passages out of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality model accepts."""
    from beaconry.llm.quality import score_quality

    kept = score_quality(docs, keep_text=True).filter("keep")
    return kept.select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest id, of each group of near-duplicates; repeated rows and rows of one id are rows of their own.

    Rows without an id come after those with one.  A text without words is in no group."""
    from beaconry.llm.common import Tables
    from beaconry.llm.minhash import near_duplicates

    # written once, as the numbers must not change between the passes
    tables = Tables(spark, "near")
    rows = tables.cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    near = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), percent=80).select(F.col("doc_id").alias("row"), "component_id")
    near = tables.cut(near.join(rows.select("row", "doc_id"), "row"))
    first = near.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m"), F.count("*").alias("c")).filter("c > 1")
    # few rows go, so their numbers move and not the texts
    gone = tables.cut(near.join(first.select("component_id", F.col("m.row").alias("first")), "component_id").filter("row != first").select("row"))
    tables.keep(rows, gone)
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the characters that lie in byte strings of 200 that stand in the corpus twice."""
    from beaconry.llm.suffix import remove_repeats

    cut = remove_repeats(docs, 200, keep_text=True)
    return cut.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, judged row by row."""
    from beaconry.llm.decontam import drop_leaks

    return drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, in sequences of 2048."""
    import public_tokenizers as P

    from beaconry.llm.packing import pack_documents

    return pack_documents(docs, P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: no SQL for the classifier, the suffix arrays and the packing; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from beaconry.llm.common import Tables

    tables, docs, old = Tables(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = tables.cut(stage(spark, docs, sf_dir))
        if old is not None:
            tables.drop(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
