"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id.

Texts are equal when identical after each run of ASCII white space becomes one space. Null counts as empty, an
empty text is a text like any other. Repeated rows (same id and text) fall into one group and count each; of equal
ids only the id is compared, so rows that share the smallest id are all marked kept (``drop_exact_copies`` keeps one of
them). A null id is kept only if its group has no other id. An empty table gives an empty result; other columns are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every white-space run except a single space, which is already in normal form.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: content_hash, text_sha256, keep_id, group_size.

    Grouping is by (hash, text): equal hashes of different bytes stay apart, and copies collapse before the shuffle,
    so a text that a third of all rows carry sends one row per task.
    """
    body = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(body.cast("binary"))).alias("content_hash"), body.alias("body"))
    groups = rows.groupBy("content_hash", "body").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.select("content_hash", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256, content_hash (binary, 16 bytes)."""
    body = normalised(F.col(text_col)).cast("binary")
    rows = docs.select(F.col(id_col).alias(id_col), F.unhex(F.md5(body)).alias("content_hash"), F.sha2(body, 256).alias("text_sha256"))
    joined = rows.join(exact_groups(docs, id_col, text_col), ["content_hash", "text_sha256"])
    return joined.select(id_col, "keep_id", "group_size", F.coalesce(F.col(id_col) == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256", "content_hash")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with all their columns.

    One aggregate whose rows carry a text once: as its normal form, and as it stands only where that differs.
    """
    body = normalised(F.col(text_col))
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    raw = F.when(F.col(text_col).isNull() | (F.col(text_col) != body), F.struct(F.col(text_col).alias("text"))).alias("raw")
    first = F.struct(F.col(id_col).isNull(), F.col(id_col))
    rows = docs.select(F.unhex(F.md5(body.cast("binary"))).alias("h"), body.alias("body"), F.struct(*rest, raw).alias("row"), first.alias("first"))
    kept = rows.groupBy("h", "body").agg(F.min_by("row", "first").alias("row"))
    text = F.when(F.col("row.raw").isNotNull(), F.col("row.raw.text")).otherwise(F.col("body"))
    return kept.select(*[(text if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op9_exact_dedup(spark, sf_dir):
    from strictpast.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents")).drop("content_hash")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
