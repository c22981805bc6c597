import math
import random
import tracemalloc
import zlib
from collections import Counter

import cases
import numpy as np
from pyspark.sql import functions as F

from codonloom.llm.language_id import AMBIGUOUS, FEATURE_BITS, SHARPNESS, Model, codewords, features, fit, identified_documents, label_documents, query


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect())
    rows = query(spark, d).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) / len(tested) > 0.98


def test_labels_of_the_held_out_fold_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    changed = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 'zz', lang) lang")
    assert sorted(label_documents(docs).collect()) == sorted(label_documents(changed).collect())


def made_up(n, each, seed=1):
    """Texts of n languages: words over letters of each language's own frequencies."""
    rng, rows = random.Random(seed), []
    for lang in range(n):
        letters = rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)
        rows += [(len(rows) + i, " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(30)), f"l{lang:04}") for i in range(each)]
    return rows


def test_fit_and_decoding_equal_brute_force(spark):
    """Log-odds of the bits counted text by text, and losses bit by bit, for 9 languages."""
    rows = made_up(9, 6)
    model = fit(spark.createDataFrame(rows, "id long, text string, lang string").repartition(5))
    counts = {}
    for _, text, lang in rows:
        counts.setdefault(lang, Counter()).update(features(text).tolist())
    langs, size = sorted(counts), 1 << FEATURE_BITS
    assert model.langs == tuple(langs)
    code = codewords(len(langs))
    p = np.array([[(counts[x][g] + 0.5) / (counts[x].total() + 0.5 * size) for g in range(size)] for x in langs])
    want = np.array([np.log(p[c > 0].mean(axis=0)) - np.log(p[c < 0].mean(axis=0)) for c in code.T]).T
    assert np.allclose(model.weights, want, atol=1e-5)
    for _, text, lang in made_up(9, 2, seed=1)[::3] + made_up(3, 2, seed=8):
        found = features(text)
        margins = [sum(want[g, b] for g in found) / len(found) for b in range(code.shape[1])]
        loss = [sum(math.log1p(math.exp(-SHARPNESS * c * m)) for c, m in zip(word, margins, strict=True)) for word in code]
        best = min(range(9), key=lambda i: loss[i])
        got = model.predict(text)
        assert got[0] == langs[best]
        assert abs(got[1] - 1 / sum(math.exp(loss[best] - x) for x in loss)) < 1e-3
        assert got[2] == (sorted(loss)[1] - loss[best] < AMBIGUOUS * code.shape[1])


def test_ties_go_to_the_first_language():
    model = Model(("a", "b", "c"), codewords(3), np.zeros((1 << FEATURE_BITS, codewords(3).shape[1]), np.float32))
    assert model.predict("some words") == ("a", 1 / 3, True)


def test_many_languages(spark):
    """2000 languages: the driver gets rows a language and weights a feature, no counts."""
    rows = made_up(2000, 2)
    docs = spark.createDataFrame([*rows, (10**6, "aaa bbb", "rare")], "id long, text string, lang string").repartition(8)
    tracemalloc.start()
    model = fit(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.langs) == 2001 and peak < 300 << 20, peak
    right = sum(model.predict(text)[0] == lang for _, text, lang in rows[::40])
    assert right > 0.1 * len(rows[::40])  # chance: 0.0005; bits over a thousand languages each are weak
    assert "rare" in model.langs  # each has a codeword, however many there are


def test_rows_without_an_id_or_with_one_id(spark):
    """They are drawn for training as rows with ids are."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang IS NOT NULL")
    for some in (None, 1):  # not held out
        got = label_documents(docs.withColumn("doc_id", F.lit(some).cast("long"))).groupBy("lang_pred").count().collect()
        want = dict(docs.groupBy("lang").count().collect())
        assert all(abs(r["count"] - want.get(r.lang_pred, 0)) < 0.1 * sum(want.values()) for r in got) and {r.lang_pred for r in got} >= set(want)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "...", None), (3, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in label_documents(docs).collect()} == {"und"}
    assert [r.doc_id for r in identified_documents(docs).collect()] == [1]


def test_codewords_are_apart():
    for n in (2, 4, 6, 9, 20):
        code = codewords(n)
        assert len({tuple(c) for c in code}) == n
        if n > 3:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3
    assert np.abs(codewords(5).sum(axis=0)).max() < 5


def test_awkward_rows(spark, tmp_path):
    d = cases.stored(cases.documents(spark), tmp_path)
    got = query(spark, d).collect()
    assert len(got) == len(cases.rows())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    und = [r for r in got if r.lang_pred == "und"]
    letters = [t is not None and any(c.isalpha() for c in t) for _, t, *_ in cases.rows()]
    assert len(und) == letters.count(False)
    assert all(r.score == 0 for r in und)
    out = identified_documents(docs)
    assert out.columns == docs.columns
    assert not cases.values(out.exceptAll(docs))
    assert out.count() == letters.count(True)
    assert label_documents(cases.empty(spark)).count() == 0
    assert identified_documents(cases.empty(spark)).count() == 0
