"""Operator 4: near-duplicate embeddings by an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codonloom.llm.common import BROADCAST_ROWS, cut, fresh, split_join, stable, table, with_row_id
from codonloom.llm.components import connected_components

COSINE = 0.93
#: The codebooks are fitted on at most this many vectors, the first by a seeded hash.
SAMPLE = 20_000
#: Share of pairs at exactly the threshold whose traversals must have a cell in common.
TARGET_RECALL = 0.99
#: Vectors for each cell of the product grid, about, and for each centre of the sample, at least.
PER_CELL, PER_CENTRE = 800, 4
#: Vectors that the traversal is calibrated on.
TRIED = 2000
#: Vectors of a cell beyond this many are dealt to further blocks.
BLOCK = 256
#: Distances held at once.
HELD = 1 << 20
SEED = 4


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)


def in_chunks(x: np.ndarray, wide: int) -> Iterator[np.ndarray]:
    step = max(1, HELD // max(wide, 1))
    return (x[at : at + step] for at in range(0, len(x), step))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([distances(part, centres).argmin(axis=1) for part in in_chunks(x, len(centres))])
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def traverse(d1: list[float], d2: list[float], visits: int) -> Iterator[tuple[int, int]]:
    """The ``visits`` pairs (i, j) of least d1[i] + d2[j], least first, of two ascending
    lists: a pair waits in a heap from when both before it have been visited."""
    heap, reached = [(d1[0] + d2[0], 0, 0)], {}
    while heap and visits:
        _, i, j = heapq.heappop(heap)
        yield i, j
        visits -= 1
        reached[i] = j + 1  # how far row i has been visited
        if i + 1 < len(d1) and reached.get(i + 1, 0) == j:
            heapq.heappush(heap, (d1[i + 1] + d2[j], i + 1, j))
        if j + 1 < len(d2) and (i == 0 or reached.get(i - 1, 0) > j + 1):
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))


@dataclass(frozen=True)
class MultiIndex:
    """A codebook for each half of a unit vector; cell i * k + j is their product."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    @property
    def dim(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def nearest_cells(self, x: np.ndarray, visits: int) -> np.ndarray:
        """For each row its ``visits`` nearest cells, nearest first, by multi-sequence
        traversal of the sorted distances to the two codebooks."""
        half, k = self.first.shape[1], len(self.second)
        visits = min(visits, len(self.first) * k)
        out = np.empty((len(x), visits), dtype=np.int32)
        done = 0
        for part in in_chunks(x, max(len(self.first), k)):
            orders, sorted_ = [], []
            for d in (distances(part[:, :half], self.first), distances(part[:, half:], self.second)):
                m = min(visits, d.shape[1])  # no pair beyond the first ``visits`` of a list is among the nearest
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                own = np.take_along_axis(d, near, axis=1)
                by = own.argsort(axis=1, kind="stable")
                orders.append(np.take_along_axis(near, by, axis=1))
                sorted_.append(np.take_along_axis(own, by, axis=1).tolist())
            for a, b, d1, d2 in zip(*orders, *sorted_, strict=True):
                out[done] = [a[i] * k + b[j] for i, j in traverse(d1, d2, visits)]
                done += 1
        return out


def met_after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the visits after which two traversals have a cell in common; one
    more than all of them if they have none."""
    m = a.shape[1]
    need = np.maximum(np.arange(m)[:, None], np.arange(m)[None, :]) + 1
    parts = [np.where(x[:, :, None] == y[:, None, :], need, m + 1).min(axis=(1, 2)) for x, y in zip(in_chunks(a, m * m), in_chunks(b, m * m), strict=True)]
    return np.concatenate(parts)


def fit_index(sample: np.ndarray, n: int, cosine: float = COSINE, recall: float = TARGET_RECALL, seed: int = SEED) -> MultiIndex:
    """Codebooks for n vectors, and the visits after which vectors at the threshold
    cosine have a visited cell in common in ``recall`` of trials: random directions
    from up to TRIED sampled vectors. The number of cells grows with n, up to the
    square of the sample's size over PER_CENTRE."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    k = 2 ** max(2, round(math.log2(max(n, 1) / PER_CELL) / 2))
    k = min(k, max(4, len(x) // PER_CENTRE))
    half = x.shape[1] // 2
    index = MultiIndex(k_means(x[:, :half], k, rng), k_means(x[:, half:], k, rng), 0)
    tried = x[:TRIED]
    away = rng.standard_normal(tried.shape)
    away -= (away * tried).sum(axis=1, keepdims=True) * tried
    other = cosine * tried + math.sqrt(1 - cosine**2) * unit(np.where(np.abs(away).sum(axis=1, keepdims=True) > 0, away, 1.0))
    most = 8
    while True:
        need = met_after(index.nearest_cells(tried, most), index.nearest_cells(other, most))
        visits = int(np.quantile(need, recall, method="higher"))
        if visits <= most or most >= len(index.first) * len(index.second):
            return MultiIndex(index.first, index.second, min(visits, most))
        most *= 2


def rows_of(column: pa.ListArray) -> list[np.ndarray]:
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def cells_of(index: MultiIndex | None):
    """mapInArrow: (rid, label, copies, vector) -> the vector's length, its bytes and the
    cells it visits, in ascending order. Vectors of another length than the index have
    one cell, -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = rows_of(batch.column(3))
            cells = [[-1]] * len(vectors)
            at = [i for i, v in enumerate(vectors) if index is not None and len(v) == index.dim]
            if at:
                near = np.sort(index.nearest_cells(unit(np.stack([vectors[i] for i in at]).astype(float)), index.visits), axis=1)
                for i, own in zip(at, near.tolist(), strict=True):
                    cells[i] = own
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(map(len, vectors), pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(cells, pa.list_(pa.int32()))],
                names=["rid", "label", "copies", "dim", "vector", "cells"],
            )

    return run


def compare_tile(cosine: float, kind: str):
    """The links of one tile: the vectors of two blocks of a cell, or of one with itself. A
    pair counts in the first of the cells that both visit. A row per vector that has
    any: its links (copies counted) and the least vector it is connected with here."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rid": [], "links": [], "root": []}).astype("int64")
        i, j, cell = (tile[c].iloc[0] for c in ("i", "j", "cell"))
        h, p = tile[tile["block"] == i], tile[tile["block"] == j]
        if h.empty or p.empty:
            return none
        hid, pid = h["rid"].to_numpy(), p["rid"].to_numpy()
        hv, pv = (unit(np.stack([np.frombuffer(v, kind) for v in x["vector"]]).astype(float)) for x in (h, p))
        linked = hv @ pv.T >= cosine
        if i == j:
            linked &= hid[:, None] < pid[None, :]
        hc, pc = (np.stack(x["cells"].to_numpy()) for x in (h, p))
        for r in np.flatnonzero(linked.any(axis=1)):
            c = np.flatnonzero(linked[r])
            linked[r, c] = ~((pc[c][:, :, None] == hc[r][hc[r] < cell]).any(axis=(1, 2)))  # met in an earlier cell
        if not linked.any():
            return none
        lh, lp = hid.copy(), pid.copy()
        far = np.iinfo(np.int64).max
        while True:
            nh = np.minimum(lh, np.where(linked, lp[None, :], far).min(axis=1))
            np_ = np.minimum(lp, np.where(linked, nh[:, None], far).min(axis=0))
            if (nh == lh).all() and (np_ == lp).all():
                break
            lh, lp = nh, np_
        out = pd.DataFrame({
            "rid": np.concatenate([hid, pid]),
            "links": np.concatenate([linked @ p["copies"].to_numpy(), linked.T @ h["copies"].to_numpy()]),
            "root": np.concatenate([lh, lp]),
        })
        return out[out["links"] > 0].groupby("rid", as_index=False).agg({"links": "sum", "root": "min"})

    return run


def link_embeddings(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, recall: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row (vec_id, embedding, label).

    Equal vectors of a label are one entry with a count. Every entry visits its nearest
    cells by multi-sequence traversal, as many as the target recall takes, and a
    pair is compared in the first cell that both visit. The entries of a cell are
    compared in tiles of BLOCK by BLOCK; a tile returns sums and a spanning forest,
    never its pairs, so a cell with a third of all rows is many even tasks.

    Vectors that are null, zero, or hold null or non-finite components, and those
    without a label, link with nothing. Very long vectors: whole; those of another
    length than the sampled ones' most common are compared with all of their label
    and length. Null vec_id: counts as the largest; alone, it is its own component.
    Ties and repeated rows link with each other; of equal ids all are kept. Empty
    table: empty result. Other columns: not read, so their names don't matter.
    """
    vectors = stable(vectors)
    element, rid = vectors.schema["embedding"].dataType.elementType, fresh(vectors, "_rid")
    number, kind = ("float", "<f4") if isinstance(element, T.FloatType) else ("double", "<f8")
    rows = with_row_id(vectors, rid).select(F.col(rid).alias("_rid"), F.col("vec_id"), F.col("label"), F.col("embedding").cast(f"array<{number}>").alias("vector"))
    fine = (
        F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    key = ["_h1", "_h2"]  # 128 bits for equal vectors of a label; the grouping holds the vectors too
    rows = rows.withColumn("_fine", F.coalesce(fine, F.lit(False))).withColumns(
        {h: F.when(F.col("_fine"), F.xxhash64(F.lit(seed), "label", "vector")) for h, seed in zip(key, (SEED, SEED + 1), strict=True)}
    )
    entries = cut(
        rows.filter("_fine").groupBy(*key, "label", "vector").agg(F.min("_rid").alias("rid"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    )
    n = entries.count()
    some = rows_of(entries.select("vector").orderBy(F.xxhash64("_h1", F.lit(SEED)), "rid").limit(sample).toArrow().column(0).combine_chunks())
    index = None
    if some:
        dims = [len(v) for v in some]
        common = max(set(dims), key=lambda d: (dims.count(d), -d))
        if common > 1:
            index = fit_index(np.stack([v for v in some if len(v) == common]).astype(float), n, cosine, recall)
    label = vectors.schema["label"].dataType.simpleString()
    placed = cut(
        entries.select("rid", "label", "copies", "vector").mapInArrow(cells_of(index), f"rid long, label {label}, copies long, dim int, vector binary, cells array<int>")
    )
    at = ["label", "dim", "cell"]
    blocks = cut(
        placed.select("label", "dim", F.explode("cells").alias("cell")).groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select(*at, F.ceil(F.col("_n") / BLOCK).cast("int").alias("nb"))
    )
    both = placed.select("label", "dim", F.explode("cells").alias("cell"), "rid", "copies", "vector", "cells")
    counted = both.join(F.broadcast(blocks), at) if blocks.count() < BROADCAST_ROWS else split_join(both, blocks, at)
    counted = counted.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tiles = counted.select(*at, F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "rid", "copies", "vector", "cells")
    links = cut(tiles.groupBy(*at, "i", "j").applyInPandas(compare_tile(cosine, kind), "rid long, links long, root long"))
    roots = connected_components(links.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("rid").agg(F.sum("links").alias("links"))
    known = entries.select(*key, "rid", "copies", "least").join(sums, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    known = cut(known.withColumn("root", F.coalesce("root", "rid")))
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    found = split_join(known, least, ["root"]).select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    out = split_join(rows.select("vec_id", *key), found, key, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))
