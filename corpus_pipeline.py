"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
between stages the rows are written as Parquet and read again, so a lost executor
costs one stage's tasks. All but the last return the columns of documents.

Every stage takes tables with further columns of any name and passes them on unchanged
(packing returns pieces instead), works on texts of any length whole, and makes an
empty table of an empty one. Nulls, ties and repeated rows: as each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codonloom.llm.common import stored, table
from codonloom.llm.exact_dedup import drop_exact_copies
from codonloom.llm.language_id import identified_documents
from codonloom.llm.mixing import mixed_documents
from codonloom.llm.ngram_join import drop_near_copies
from codonloom.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: null, empty, or without a letter. Ambiguous ones
    and ties between languages stay, and so does a row whose id, lang or source is
    null. Repeated rows are judged alike. Without any labelled row, all rows with a
    letter stay."""
    return identified_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space, null and empty ones included, one stays: the
    longest; of those the one of the smallest id, null ids last; of repeated rows that
    of the smallest row number."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8 or more, one stays: that of the
    smallest id, null ids last; of repeated rows that of the smallest row number. A
    null or empty text links with nothing and stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; some not at all. A null
    source is one of its own; null and empty texts have no words and come as often as
    their source's whole repetitions. Ties and repeated rows count each by itself."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, repeats included, and their places in sequences. A
    null or empty text is one token, a null id stays null; a longer text than a
    sequence is cut. Ties between pieces of a length go by task and place in it."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: MinHash, learned models and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
