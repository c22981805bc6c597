"""Numbering the rows of a key in order, and hashing pieces in order, for keys of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonloom.llm.common import cut


def positions(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """rows with _part and _pos: the number of a row, from 1 up, among the rows of its key.

    One range-partitioned sort by key and order; a row's number is its place among the
    key's rows in its partition and the number of those in the partitions before. So
    the rows of a key may be spread over any number of partitions, _part.
    """
    at = cut(rows.orderBy(key, *order).withColumn("_m", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_m", 33))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = at.groupBy(key, "_part").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = runs.select(key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return at.join(runs, [key, "_part"]).withColumn("_pos", F.col("_m") + F.col("_shift")).drop("_m", "_shift")


def hash_in_order(pieces: DataFrame, key: list[str], order: str, piece: str, kind: str) -> DataFrame:
    """key columns (types: ``kind``) and sha256, the hexadecimal hash of the key's pieces,
    comma-joined in order. The pieces of a key pass one task, as SHA-256 needs them one
    after the other; they are sorted on disk if need be and never held together."""
    schema = f"{kind}, sha256 string"
    names = [*key, "sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            *columns, texts = (c.to_pylist() for c in batch.columns)
            for k, text in zip(zip(*columns), texts):
                if k == now:
                    sha.update(b"," + text.encode())
                    continue
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = k, hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, sha.hexdigest())], names)

    dealt = pieces.repartition(*key).sortWithinPartitions(*key, order).select(*key, piece)
    return dealt.mapInArrow(run, schema)
