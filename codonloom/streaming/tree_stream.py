"""Split counts of trees as they arrive: a hook on each batch of a stream of tree files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codonloom.operators.lineage import cut
from codonloom.operators.trees import PRINT, shown_edge, split_lists, split_prints, tour

SCHEMA = "tree_id long, node_idx int, parent_idx int, name string, is_tip boolean, branch_len double"


def counted(trees: DataFrame) -> DataFrame:
    """split, n_edges, sum_len: the splits of a batch's trees."""
    placed = tour(trees)
    found = cut(split_prints(placed).groupBy(*PRINT).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("branch_len").alias("sum_len"), shown_edge()))
    return found.drop("_r").join(split_lists(found, placed), PRINT).select("split", "n_edges", "sum_len")


def watch_splits(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """A streaming query over Parquet files of trees, each tree whole in one file, that
    writes the counts of every batch as a folder of its own under ``out``.

    A batch that runs again, after a lost driver, writes the same folder again, so the
    totals count each tree once; the checkpoint tells which files are done. The state
    is the table ``out``, not memory."""

    def add(batch: DataFrame, number: int) -> None:
        counted(cut(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_totals(spark: SparkSession, out: str) -> DataFrame:
    """split, n_edges, mean_len over all batches so far."""
    rows = spark.read.schema("split array<int>, n_edges long, sum_len double, batch long").parquet(out)
    sums = rows.groupBy("split").agg(F.sum("n_edges").alias("n_edges"), F.sum("sum_len").alias("_len"))
    return sums.select("split", "n_edges", (F.col("_len") / F.col("n_edges")).alias("mean_len"))
