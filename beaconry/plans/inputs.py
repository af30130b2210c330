"""Derived inputs of the registered queries, in SQL that Spark and DuckDB share.

The tables hold no crisis vocabulary, so a feed of phrases is derived from the ids of `documents`, a golden set and
predictions from `labels`, and model responses from `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = """
SELECT doc_id AS seq,
       CASE doc_id % 10
         WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'bot  network coordinated' ELSE 'bot network coordinated' END
         WHEN 1 THEN 'shooting reported downtown'
         WHEN 2 THEN 'earthquake and tsunami warning'
         WHEN 3 THEN 'see https://example.org/a now'
         WHEN 4 THEN 'suicide bombing near the plaza'
         WHEN 5 THEN CASE WHEN doc_id % 3 = 0 THEN 'bot  network raid' ELSE 'bot network raid' END
         WHEN 6 THEN 'massacre, shooting https://example.org/b'
         WHEN 7 THEN 'Überfall und Attentat gemeldet'
         WHEN 8 THEN 'inundación tornado ouragan'
         ELSE 'quiet day in the park' END
       || ' case ' || CAST(CASE WHEN doc_id % 5 = 0 THEN doc_id % 100 ELSE doc_id END AS STRING) AS text,
       source,
       CASE WHEN doc_id % 41 = 0 THEN 'it' ELSE lang END AS language,
       CAST(1704067200 + 25 * CASE WHEN doc_id % 400 BETWEEN 300 AND 339
                                   THEN doc_id - doc_id % 400 + 300 ELSE doc_id END AS DOUBLE) AS timestamp
FROM documents"""

#: the feed's phrases in front of whole documents, and a phrase of the category that the feed lacks
POSTS = f"""
SELECT f.seq, CASE f.seq % 10 WHEN 9 THEN 'grooming of an underage user' ELSE f.text END || chr(10) || coalesce(d.text, '') AS text,
       f.source, f.language, f.timestamp
FROM ({FEED}) f JOIN documents d ON d.doc_id = f.seq"""

GOLDEN = """
SELECT 'EX-' || CAST(doc_id AS STRING) AS example_id, doc_id AS pos, 'example ' || CAST(doc_id AS STRING) AS text,
       CASE WHEN toxic = 1 AND quality = 0 THEN 'coordinated_harassment|misinformation'
            WHEN toxic = 1 THEN 'coordinated_harassment'
            WHEN quality = 0 THEN 'misinformation'
            WHEN doc_id % 5 = 0 THEN 'self_harm|self_harm' ELSE '' END AS labels,
       CASE WHEN toxic = 1 THEN 'P1' WHEN quality = 0 THEN 'P2' ELSE 'P4' END AS true_severity
FROM labels
UNION ALL
SELECT 'EX-' || CAST(doc_id AS STRING), doc_id + 1000000000, 'again ' || CAST(doc_id AS STRING), 'data_breach', 'P3'
FROM labels WHERE doc_id % 11 = 0"""

PREDICTIONS = """
SELECT 'EX-' || CAST(doc_id AS STRING) AS example_id, doc_id AS pos,
       CASE doc_id % 4 WHEN 0 THEN 'coordinated_harassment' WHEN 1 THEN 'misinformation|regulatory'
            WHEN 2 THEN 'self_harm' ELSE '' END AS labels,
       'P' || CAST(doc_id % 5 AS STRING) AS predicted_severity, CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence
FROM labels WHERE doc_id % 7 <> 0"""

RESPONSES = """
SELECT doc_id AS seq, 'S-' || CAST(doc_id AS STRING) AS signal_id,
       CASE doc_id % 9
         WHEN 0 THEN '{"labels": [{"type": "self_harm", "confidence": 0.9, "reasoning": "r"}, {"type": "regulatory", "confidence": 0.95}], "overall_severity": "P1", "requires_human_review": true, "escalation_note": "now"}'
         WHEN 1 THEN '```json' || chr(10) || '{"labels": [{"type": "other", "confidence": 0.7}], "overall_severity": "P2"}' || chr(10) || '```'
         WHEN 2 THEN 'oops {'
         WHEN 3 THEN '[1, 2]'
         WHEN 4 THEN '{"labels": [{"type": "nonexistent", "confidence": 0.9}, {"type": "data_breach", "confidence": 0.2}, {"type": "misinformation", "confidence": 0.6}], "overall_severity": "P3"}'
         WHEN 5 THEN '{"labels": [{"type": "child_safety", "confidence": 1.7}], "overall_severity": "P9"}'
         WHEN 6 THEN '  {"labels": [{"type": "other", "confidence": 0.8}, {"type": "self_harm", "confidence": 0.85}, {"type": "regulatory", "confidence": 0.8}, {"type": "data_breach", "confidence": 0.8}], "overall_severity": "P0"} '
         WHEN 7 THEN '{"_parse_error": true}'
         ELSE '{"overall_severity": "P4"}' END AS response
FROM documents"""

SQL = {"feed": FEED, "posts": POSTS, "golden": GOLDEN, "predictions": PREDICTIONS, "responses": RESPONSES}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame; labels are arrays."""
    table = "labels" if name in ("golden", "predictions") else "documents"
    view = f"beaconry_{table}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(view)
    out = spark.sql(SQL[name].replace(f"FROM {table}", f"FROM {view}").replace(f"JOIN {table}", f"JOIN {view}"))
    if name in ("golden", "predictions"):
        out = out.withColumn("labels", F.filter(F.split("labels", "[|]"), lambda x: x != ""))
        out = out.withColumnRenamed("labels", "true_labels" if name == "golden" else "predicted_labels")
    return out
