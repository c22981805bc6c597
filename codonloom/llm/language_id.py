"""Operator 7: language identification by error-correcting output codes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.llm.common import cut, small, stable, table, with_row_id

#: Hashed n-gram features of 1 to 3 characters.
FEATURE_BITS = 14
#: Expected training texts of a language; more are thinned by a seeded hash.
PER_LANGUAGE = 400
#: Languages whose counts a training task holds at once.
HELD = 256
SMOOTH = 0.5
SEED = 77
#: Two codewords whose losses differ by less than this share of the bits are too close to call.
AMBIGUOUS = 0.02
SHARPNESS = 6.0


def features(text: str) -> np.ndarray:
    """Feature numbers of all 1-, 2- and 3-grams of a whole text; ASCII non-letters are spaces."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c = np.where((c < 128) & ((c < 97) | (c > 122)), np.uint64(32), c)
    one = c + np.uint64(1)
    two = one[1:] + one[:-1] * np.uint64(0x110001)
    three = two[1:] + one[:-2] * np.uint64(0x110001 * 0x110001 % 2**64)
    grams = np.concatenate([one, two, three])
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """A row of +1 and -1 for each of n languages. Up to 6: the exhaustive code, all
    splits in two. More: the seeded random code of largest distance among 50."""
    if n < 3:
        return np.array([[1], [-1]][:n], dtype=np.int8).reshape(n, 1)
    if n <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.int8).T
    rng, bits = np.random.default_rng(seed), 2 * math.ceil(8 * math.log2(n))
    best, far = None, -1
    for _ in range(50 if n < 256 else 5):
        code = rng.choice(np.array([1, -1], dtype=np.int8), size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - most_alike(code)) // 2
        if apart > far:
            best, far = code, apart
    return best


def most_alike(code: np.ndarray, rows: int = 1024) -> int:
    """Agreements less differences of the two codewords closest to each other."""
    wide, most = code.astype(np.float32), -code.shape[1]
    for at in range(0, len(wide), rows):
        same = wide[at : at + rows] @ wide.T
        same[np.arange(len(same)), at + np.arange(len(same))] = -code.shape[1]
        most = max(most, int(same.max()))
    return most


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # feature x bit

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, share of the decoding it wins, and whether it is ambiguous."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        found = features(text)
        margins = np.zeros(self.weights.shape[1])
        for at in range(0, len(found), 1 << 16):
            margins += self.weights[found[at : at + (1 << 16)]].sum(axis=0)
        margins /= len(found)
        # Loss of a codeword: the logistic loss of each bit's margin, summed.
        one, other = np.logaddexp(0.0, -SHARPNESS * margins), np.logaddexp(0.0, SHARPNESS * margins)
        loss = (self.code > 0) @ one + (self.code < 0) @ other
        best = int(np.argmin(loss))
        share = np.exp(loss[best] - loss)
        second = np.partition(loss, 1)[1] if len(loss) > 1 else math.inf
        return self.langs[best], float(1.0 / share.sum()), bool(second - loss[best] < AMBIGUOUS * self.code.shape[1])


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (number of a language, text) -> counts (lang, gram, n)."""
    held: dict[int, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": np.full(len(at), lang, np.int32), "gram": at.astype(np.int32), "n": n[at]})
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            add = np.bincount(features(text), minlength=1 << FEATURE_BITS)
            held[lang] = held[lang] + add if lang in held else add
            if len(held) >= HELD:
                yield from flush()
    yield from flush()


def bit_weights(p: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log-odds (row, bit) of features with probabilities p (row, language): their mean
    over the languages whose codeword has the bit against that over the others."""
    one, other = code > 0, code < 0
    mean = p.mean(axis=1, keepdims=True)
    a, b = (np.where(side.any(axis=0), p @ side / np.maximum(side.sum(axis=0), 1), mean) for side in (one, other))
    return np.log(a) - np.log(b)


def weigh(code: np.ndarray, totals: np.ndarray):
    """mapInArrow: (gram, counts as (lang, n)) -> (gram, weights of its bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (lang, n) = batch.column(1).offsets.to_numpy(), [f.to_numpy() for f in batch.column(1).values.flatten()]
            made = []
            for i, j in zip(at[:-1], at[1:], strict=True):
                counts = np.zeros(len(totals))
                counts[lang[i:j]] = n[i:j]
                made.append(bit_weights(((counts + SMOOTH) / totals)[None, :], code)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["gram", "w"])

    return run


def held_out(docs: DataFrame, id_col: str = "doc_id"):
    """The fold of a row: crc32 of its id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, seed: int = SEED) -> Model:
    """Fit on rows (id, text, lang), for every language that has a text. At most about
    per_language texts of each are used, whole, chosen by a hash of ``id``, which should
    tell rows apart. The driver receives a row for each language, and for each feature
    the weights of its bits; counts are summed and weighed on executors."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    if not sizes:
        return Model((), np.zeros((0, 0)), np.zeros((0, 0)))
    langs = tuple(sorted(r["lang"] for r in sizes))
    number = {lang: i for i, lang in enumerate(langs)}
    rows = [(r["lang"], number[r["lang"]], per_language / r["n"]) for r in sizes]
    shares = small(labelled.sparkSession.createDataFrame(rows, "lang string, _l int, _share double"), len(rows))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    chosen = known.join(shares, "lang").filter(draw < F.col("_share"))
    grams = cut(chosen.select("_l", "text").mapInArrow(count_grams, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = np.full(len(langs), SMOOTH * (1 << FEATURE_BITS))
    for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect():  # a row a language
        totals[r["lang"]] += r["n"]
    code = codewords(len(langs), seed)
    by_gram = grams.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("counts"))
    found = by_gram.mapInArrow(weigh(code, totals), "gram int, w array<double>").toArrow()  # at most 2^FEATURE_BITS rows
    weights = np.repeat(bit_weights((SMOOTH / totals)[None, :], code), 1 << FEATURE_BITS, axis=0).astype(np.float32)
    if found.num_rows:
        weights[found["gram"].to_numpy()] = found["w"].combine_chunks().values.to_numpy().reshape(found.num_rows, -1)
    return Model(langs, code, weights)


def identifier(model: Model):
    """A column function of text: struct of lang, score and ambiguous."""

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def identify(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "ambiguous"])

    return identify


def trained_on(docs: DataFrame) -> Model:
    """Learn from the rows outside the held-out fold. They are drawn by their place in
    the table, so rows of one id, or without one, are drawn like others."""
    docs = stable(docs.select("doc_id", "text", "lang"))
    rows = with_row_id(docs).filter(~held_out(docs))
    return fit(rows.select(F.col("_rid").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))


def label_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row of docs.

    Learns from the rows of docs outside the held-out fold; only text is an input of
    a prediction. Null text, and text without a letter (empty too): und, score 0.
    No labelled row at all: und for every row. Very long texts: whole, in strips.
    Repeated rows: each on its own. Null id: not held out. Ties between codewords:
    the first language by code point. Empty table: empty result. Other columns: not
    read, so their names don't matter.
    """
    docs_out = docs.select("doc_id", held_out(docs).alias("held_out"), identifier(trained_on(docs))(docs["text"].cast("string")).alias("r"))
    return docs_out.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score", "r.ambiguous")


def lettered(texts: pd.Series) -> pd.Series:
    return texts.map(has_letter).astype(bool)


def identified_documents(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language cannot be told: und, that is null texts
    and texts without a letter. An ambiguous row stays: doubt about which language
    it is in doesn't make a text bad. Without a labelled row there is no language to
    tell, and rows with a letter stay. All columns stay, whatever their names;
    repeated rows, ties, very long texts and empty tables: as in label_documents."""
    model = trained_on(docs)
    if not model.langs:
        return docs.filter(F.pandas_udf(lettered, "boolean")(docs["text"].cast("string")))
    return docs.filter(identifier(model)(docs["text"].cast("string")).getField("lang") != "und")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_documents(table(spark, sf_dir, "documents"))
