"""The relations that queries start from, as SQL text that Spark and an oracle both read.

No image tables exist here, so driver tables stand in: line items are pixels,
documents are specimens with their source as family, labels give support,
embeddings are crop features, events are epoch metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PIXELS = """
SELECT l_suppkey AS stem, l_orderkey * 8 + l_linenumber AS pix,
       CAST((l_orderkey * 7 + l_linenumber * 31) % 256 AS INT) AS r,
       CAST((l_partkey * 13 + l_linenumber * 17) % 256 AS INT) AS g,
       CAST((l_suppkey * 29 + l_orderkey * 3) % 256 AS INT) AS b
FROM lineitem"""

ITEMS = """
SELECT d.doc_id AS stem, d.source AS family, CASE d.lang WHEN 'en' THEN 'Back' WHEN 'fr' THEN 'Belly' ELSE 'Side' END AS view,
       l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

EPOCHS = """
SELECT CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS epoch, event_type AS term, avg(value) AS loss
FROM events GROUP BY 1, 2"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a relation's SQL over the tables in sf_dir (no view outlives the call)."""
    frames = {name: table(spark, sf_dir, name) for name in TABLES if f" {name}" in sql}
    text = sql
    for name in frames:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    text = text.replace("datediff('day', DATE '2024-01-01', CAST(ts AS DATE))", "datediff(CAST(ts AS DATE), DATE '2024-01-01')")
    return spark.sql(text, **frames)
