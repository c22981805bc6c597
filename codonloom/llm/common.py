"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: space, tab, LF, VT, FF, CR.
SPACE = " \t\n\x0b\x0c\r"
#: One more than the most rows a table may have to be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000
#: Rows of a small table in one checkpoint file.
ROWS_A_FILE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder. Where none is named, a local master (tests) gets
    a temporary one; a cluster, whose executors would not see it, is refused."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder. With a bound of
    its rows, in a file for each ROWS_A_FILE of them instead of one a partition."""
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; else as it is."""
    return F.broadcast(df) if rows < limit else df


def without_space(text: Column) -> Column:
    """text without the characters of SPACE; searching for each is several times as
    fast as translating every character."""
    for ch in SPACE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def text_of(docs: DataFrame, name: str = "text") -> Column:
    return F.coalesce(docs[name].cast("string"), F.lit(""))


#: Plans of these nodes alone keep the place of every row in its file.
STABLE = {"Relation", "Project", "Filter", "SubqueryAlias"}


def stable(docs: DataFrame) -> DataFrame:
    """docs itself if it is a scan of Parquet files; else docs written as such, so that
    every row has a place that later jobs find again."""
    plan = docs._jdf.queryExecution().analyzed()
    tree = plan.toString()
    nodes = re.findall(r"^[\s:+\-]*'?([A-Z]\w+)", tree, re.MULTILINE)
    if set(nodes) <= STABLE and nodes.count("Relation") == 1 and re.search(r"Relation \[.*\] parquet\s*$", tree) and plan.deterministic():
        listed = plan.collectLeaves().apply(0).relation().location().inputFiles()
        if len(listed) == len(docs.inputFiles()):  # no file is read twice
            return docs
    return stored(docs, "rows")


def file_hash(name: str, tries: int) -> int:
    """What ``xxhash64(name, tries)`` is in Spark."""
    return xxhash.xxh64_intdigest(tries.to_bytes(4, "little"), xxhash.xxh64_intdigest(name.encode(), 42))


def with_row_id(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """A number from 0 up for each row of a stable table: bits that tell its file, then
    the row's place in the file. Neither depends on how a job splits the files, so
    jobs agree on the numbers, whatever cores they have, and tasks that run again do.

    A file's bits are a hash of its path below the table, so a table that is moved
    keeps its numbers; the driver, which lists the files anyway, picks the first
    seed that tells them all apart. n files take about 2 log2(n) bits; a row beyond
    what the other bits hold (5e8 rows in each of 1e5 files) is an error.
    """
    files = [re.sub(r"^\w*:?/*", "/", f) for f in docs.inputFiles()]
    root = os.path.commonpath([os.path.dirname(f) for f in files]) if files else "/"
    below = [f[len(root) :].lstrip("/") for f in files]
    bits, tries = max(8, math.ceil(2 * math.log2(max(len(files), 1)))), 0
    while len({file_hash(f, tries) % (1 << bits) for f in below}) < len(below):
        tries += 1
    place = docs.metadataColumn("_metadata")
    path = F.ltrim(F.substring(F.regexp_replace(place["file_path"], r"^\w*:?/*", "/"), len(root) + 1, 1 << 30), F.lit("/"))
    own = F.shiftleft(F.xxhash64(path, F.lit(tries)).bitwiseAND((1 << bits) - 1), 63 - bits)
    row = F.when(place["row_index"] < F.lit(1 << (63 - bits)), place["row_index"]).otherwise(F.raise_error(F.lit("too many rows in one file")).cast("long"))
    return docs.withColumn(name, own.bitwiseOR(row))


def fresh(docs: DataFrame, name: str) -> str:
    """name, or the first of name_, name__, ... that is no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on the columns named in ``on`` that Spark may split at hot keys.

    A side that an aggregate already partitioned by the keys would be used as it
    is, and one task would get all rows of a key. With a hash of the keys as one
    more key, both sides are shuffled for the join, and AQE splits large partitions.
    """
    key = F.xxhash64(*[F.col(c) for c in on]).alias("_join")
    return left.select("*", key).join(right.select("*", key), [*on, "_join"], how).drop("_join")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet under the shared checkpoint folder and read again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.parquet(path)
