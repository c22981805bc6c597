"""Live diagnostics: running summaries of a trace folder that chains still write to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "iteration long, chain int, param string, value double"


def read_trace_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_summary(stream: DataFrame) -> DataFrame:
    """chain, param, n, mean, variance, last iteration: state is one row a chain and parameter."""
    return stream.groupBy("chain", "param").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.max("iteration").alias("last_iteration")
    )


def watch(spark: SparkSession, path: str, name: str, checkpoint: str):
    """A streaming query that keeps the summary in the memory table ``name``; with
    the checkpoint it goes on where a lost driver stopped."""
    return (
        running_summary(read_trace_stream(spark, path)).writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
