"""Operator 5: n-gram Jaccard join by MinHash banding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.llm.common import cut, fresh, split_join, stable, table, text_of, with_row_id
from codonloom.llm.components import connected_components
from codonloom.llm.shingles import MinHash, normalised, shingles

SIMILARITY = 0.8
#: Share of pairs at exactly the similarity that must share a band.
RECALL = 0.99999
ROWS = 4
#: Documents that share a band meet only if their signatures agree this much: a chance
#: match of one band doesn't chain groups. At the similarity, agreement is over 4 deviations above.
AGREE = 0.6
#: A block of a group: at most about this many documents and shingles.
BLOCK, BLOCK_SHINGLES = 64, 500_000
#: A block of a band's documents whose signatures are compared with each other.
BAND_BLOCK = 256
SEED = 5


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` minima so that 1 - (1 - s^rows)^bands reaches the recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def sketch(bands: int, rows: int, seed: int):
    """mapInArrow: (rid, id, text) -> key of the word sequence, shingles, bands, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = MinHash(bands, rows, seed)
        for batch in batches:
            keys, n, found, signs = [], [], [], []
            for text in batch.column(2):
                norm = normalised(text.as_py())
                h = shingles(norm)
                keys.append(hashlib.md5(norm.encode("utf-8", "surrogatepass")).digest() if len(h) else None)
                n.append(len(h))
                own, sign = hashes.signature(h) if len(h) else (np.zeros(0, np.int64), b"")
                found.append(own)
                signs.append(sign)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                names=["rid", "id", "key", "n", "bands", "sign"],
            )

    return run


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def agreeing(least: float):
    """mapInArrow: (band, i, j, rid, sign), tiles in one piece -> a spanning forest (a, b) of
    the documents of each tile whose signatures agree to ``least``, all pairs considered."""

    def forest(ids: np.ndarray, signs: np.ndarray) -> Iterator[tuple[int, int]]:
        left = np.arange(len(ids))
        while len(left) > 1:
            root, todo, left = left[0], [left[0]], left[1:]
            while todo and len(left):
                hit = (signs[left] == signs[todo.pop()]).mean(axis=1) >= least
                todo += left[hit].tolist()
                yield from ((int(ids[x]), int(ids[root])) for x in left[hit])
                left = left[~hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, new]) if held is not None else new
            if held is None or not held.num_rows:
                continue
            key = np.stack([held.column(k).to_numpy() for k in range(3)], axis=1)
            bounds = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            ends = np.append(bounds[1:], held.num_rows)
            whole = len(bounds) - (batch is not None)  # the last tile may go on in the next batch
            if not whole:
                continue
            ids = held.column(3).to_numpy()
            signs = np.frombuffer(b"".join(held.column(4).to_pylist()), np.uint8).reshape(held.num_rows, -1)
            found = {e for lo, hi in zip(bounds[:whole], ends[:whole], strict=True) for e in forest(ids[lo:hi], signs[lo:hi])}
            held = held.slice(ends[whole - 1])
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def shingle_sets(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: np.unique(shingles(normalised(t))).tobytes())


def tiled(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """A row for each tile (i, j) of its group's nb blocks that a row's block is part of."""
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("_o")
    return rows.select(group, "block", *[c for c in columns if c != "block"], other).select(group, F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), *columns)


def compare_tile(similarity: float):
    """The links of a tile: two blocks of a group, or one with itself, on whole sets.
    A row per document that has any: its links (copies counted) and the least
    document it is connected with in the tile."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rid": [], "links": [], "root": []}).astype("int64")
        tile = tile.sort_values("rid", ignore_index=True)
        m = len(tile)
        if m < 2:
            return none
        sets = [np.frombuffer(s, np.uint64) for s in tile["shingles"]]
        sizes = np.array([len(s) for s in sets])
        _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), sizes)
        shared = times[col] > 1
        col, row = col[shared], row[shared]
        order = np.argsort(col, kind="stable")
        col, row = np.unique(col[order], return_inverse=True)[1], row[order]
        common = np.zeros((m, m))
        wide = col[-1] + 1 if len(col) else 0
        for lo in range(0, wide, 4096):  # columns in strips: bounded memory for long texts
            at = slice(*np.searchsorted(col, (lo, lo + 4096)))
            strip = np.zeros((m, 4096), dtype=np.float32)
            strip[row[at], col[at] - lo] = 1
            common += strip @ strip.T
        linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        block, (i, j) = tile["block"].to_numpy(), (tile["i"].iloc[0], tile["j"].iloc[0])
        if i != j:
            linked &= block[:, None] != block[None, :]
        if not linked.any():
            return none
        ids = tile["rid"].to_numpy()
        root = ids.copy()
        while True:
            new = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == root).all():
                break
            root = new
        out = pd.DataFrame({"rid": ids, "links": linked @ tile["copies"].to_numpy(), "root": root})
        return out[out["links"] > 0]

    return run


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """_rid, id, class_id, n_links and kept for each row of docs.

    Texts with the same words (lower case, white space aside) are one entry with a
    count. Entries that share a band and whose signatures agree roughly form candidate
    groups: each is compared with the band's first entry, and where one fails, all of
    the band's entries with each other. Inside a group all pairs are verified on their
    full sets of five-word shingles. Both work in tiles of two blocks; a tile returns
    sums and a spanning forest, never its pairs; a large band or group is many tiles.
    Counts and classes are then sums and connected components.

    class_id: the smallest id that links lead to, itself included; kept: one row of
    each class, that with the smallest id. n_links: the other rows with Jaccard >=
    similarity, copies included.

    Null text: as empty. A text without words links with nothing. One to four words
    are one shingle. Very long texts: whole, all their shingles are compared; a tile
    holds two texts at least, whatever their length. Ties and repeated rows: of
    equal ids that of the smallest row number stays. Null id: the largest; alone,
    its class is null. Empty table: empty result. Other columns: not read, so their
    names don't matter.
    """
    bands = bands_for(similarity, recall)
    docs = stable(docs)
    rid = fresh(docs, "_rid")
    source = with_row_id(docs, rid).select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    members = cut(source.mapInArrow(sketch(bands, ROWS, SEED), "rid long, id long, key binary, n long, bands array<long>, sign binary"))
    entries = cut(
        members.filter("key is not null").groupBy("key")
        .agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    )
    own = members.join(entries.select("rid"), "rid", "left_semi")
    banded = own.select("rid", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    led = split_join(banded, buckets, ["band"])
    signs = own.select("rid", "sign")
    pairs = led.filter("rid != first").select("rid", "first").distinct()
    met = split_join(split_join(pairs, signs, ["rid"]), signs.select(F.col("rid").alias("first"), F.col("sign").alias("_sign")), ["first"])
    agree = F.pandas_udf(agreement, "double")
    judged = cut(met.select("rid", "first", (agree("sign", "_sign") >= AGREE).alias("agrees")))
    missed = led.filter("_n > 2").join(judged.filter("not agrees").select("rid", "first"), ["rid", "first"], "left_semi")
    mixed = missed.groupBy("band").agg(F.ceil(F.first("_n") / BAND_BLOCK).cast("int").alias("nb"))
    rest = split_join(split_join(banded, mixed, ["band"]), signs, ["rid"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int"))
    met_again = tiled(rest, "band", "rid", "sign").select("band", "i", "j", "rid", "sign").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    near = judged.filter("agrees").select(F.col("rid").alias("a"), F.col("first").alias("b")).union(met_again.mapInArrow(agreeing(AGREE), "a long, b long"))
    stars = connected_components(near)
    groups = cut(stars.select(F.col("node").alias("rid"), F.col("root").alias("grp")).union(stars.select(F.col("root").alias("rid"), F.col("root").alias("grp")).distinct()))
    sized = groups.join(members.select("rid", "n"), "rid")
    blocks = sized.groupBy("grp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    candidates = cut(split_join(groups, blocks, ["grp"]).join(entries.select("rid", "copies"), "rid"))
    texts = source.select("rid", "text").join(candidates.hint("merge"), "rid")  # a shuffle at every size
    sets = texts.select("rid", "grp", "copies", "nb", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int").alias("block"), F.pandas_udf(shingle_sets, "binary")("text").alias("shingles"))
    tiles = tiled(sets, "grp", "rid", "copies", "block", "shingles")
    links = cut(tiles.groupBy("grp", "i", "j").applyInPandas(compare_tile(similarity), "rid long, links long, root long"))
    roots = connected_components(links.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("rid").agg(F.sum("links").alias("links"))
    known = entries.join(sums, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    known = cut(known.select("key", "copies", "least", "root", F.coalesce("links", F.lit(0)).alias("links")))
    least = known.groupBy("root").agg(F.min("least").alias("class_id"))
    found = split_join(known, least, ["root"]).select("key", "root", (F.col("links") + F.col("copies") - 1).alias("n_links"), "class_id")
    rows = split_join(members.select("rid", "id", "key"), found, ["key"], "left")
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))
    kept = rows.filter("root is not null").groupBy("root").agg(F.min(rank).alias("_k")).select("root", F.col("_k.rid").alias("_keep"))
    out = split_join(rows, kept, ["root"], "left")
    return out.select(
        F.col("rid").alias("_rid"), "id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("rid") == F.col("_keep"), F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, with the columns of docs, whatever their
    names. Nulls, ties, repeated rows and empty tables: as in join_documents."""
    docs = stable(docs)
    rid = fresh(docs, "_rid")
    gone = cut(join_documents(docs).filter(~F.col("kept")).select(F.col("_rid").alias(rid)))
    return with_row_id(docs, rid).join(gone.hint("merge"), rid, "left_anti").drop(rid)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, kept: one row per document."""
    return join_documents(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links", "kept")
