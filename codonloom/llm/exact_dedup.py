"""Operator 10: exact duplicates by 128-bit content hash, with byte comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.llm.common import fresh, stable, table, text_of, with_row_id, without_space


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its group of equal texts.

    Texts are equal when identical without white space. Rows meet on the MD5 of
    that form *and* on its bytes: the grouping keys of the first aggregate hold the
    whole text, so two texts with one hash stay apart. Copies are collapsed before
    the shuffle (partial aggregate), so a group of any size sends one row a task.

    Returns ``_rid`` (the row's number), ``_id``, ``_sha`` (SHA-256 of the normalised
    text), ``keep_id``, ``group_size`` and ``kept``.

    Null text: as empty, so all null and empty texts are one group. Very long texts:
    whole, as grouping keys. Ties in length: the smallest id stays; null ids come
    after every other. Repeated rows, the same id included: the one of the smallest
    row number stays. Empty table: empty result. Other columns: not read, so their
    names don't matter.
    """
    docs = stable(docs)
    rid, norm = fresh(docs, "_rid"), without_space(text_of(docs, text_col))
    base = with_row_id(docs, rid).select(
        F.col(rid).alias("_rid"),
        F.col(id_col).alias("_id"),
        F.length(text_of(docs, text_col)).alias("_n"),
        norm.alias("_norm"),
    ).withColumn("_h", F.unhex(F.md5("_norm")))
    # Bitwise not reverses the order of longs without overflow: the largest struct is the
    # longest text, then the smallest id, then the first row.
    rank = F.struct(F.col("_n"), F.bitwise_not("_id").alias("nid"), F.bitwise_not("_rid").alias("nrid"))
    classes = (
        base.groupBy("_h", "_norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("_best"))
        .select(
            F.col("_h").alias("_ch"),
            F.sha2("_norm", 256).alias("_csha"),
            "group_size",
            F.bitwise_not("_best.nid").alias("keep_id"),
            F.bitwise_not("_best.nrid").alias("_keep_rid"),
        )
    )
    rows = base.withColumn("_sha", F.sha2("_norm", 256)).drop("_norm")
    return rows.join(classes, (F.col("_h") == F.col("_ch")) & (F.col("_sha") == F.col("_csha"))).select(
        "_rid", "_id", "_sha", "keep_id", "group_size", (F.col("_rid") == F.col("_keep_rid")).alias("kept")
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without its exact copies, with the columns of docs, whatever their names.
    Nulls, ties, repeated rows and empty tables: as in exact_groups."""
    docs = stable(docs)
    rid = fresh(docs, "_rid")
    gone = exact_groups(docs).filter(~F.col("kept")).select(F.col("_rid").alias(rid))
    return with_row_id(docs, rid).join(gone, rid, "left_anti").drop(rid)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256")
    )


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM r
"""
