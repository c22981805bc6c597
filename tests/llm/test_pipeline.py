from collections import Counter

import cases
import corpus_pipeline
from test_ngram_join import brute as near_brute

from codonloom.llm.common import stored


def test_stages_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns, name
        kept.append(docs)
    rows = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in kept]
    assert set(rows[1]) == {i for i, t in rows[0].items() if t and any(map(str.isalpha, t))}
    norm = Counter("".join(t.split()) for t in rows[1].values())
    assert Counter("".join(t.split()) for t in rows[2].values()) == Counter(dict.fromkeys(norm, 1))
    assert set(rows[3]) == {i for i, least, _ in near_brute(list(rows[2].items())) if i == least}
    assert set(rows[4]) <= set(rows[3])
    packed = corpus_pipeline.packing(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(rows[4])
    assert sum(r.start == 0 for r in packed) == kept[4].count()


def test_stages_on_awkward_rows(spark, tmp_path):
    """Each stage by itself: rows come through with all their columns, or not at all."""
    docs = spark.read.parquet(cases.stored(cases.documents(spark), tmp_path) + "/documents.parquet")
    empty = spark.read.parquet(cases.stored(cases.empty(spark), tmp_path / "e") + "/documents.parquet")
    there = Counter(cases.values(docs))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, none = stage(spark, docs, ""), stage(spark, empty, "")
        assert got.columns == none.columns == docs.columns, name
        kept = Counter(cases.values(got))
        assert none.count() == 0 and kept and set(kept) <= set(there), name
        assert name == "mixing" or kept <= there, name
    packed = corpus_pipeline.packing(spark, docs, "").collect()
    assert sum(r.start == 0 for r in packed) == docs.count() and corpus_pipeline.packing(spark, empty, "").count() == 0


def test_run(spark, tmp_path):
    d = cases.stored(cases.documents(spark), tmp_path)
    first = sorted((str(r.doc_id), r.piece, r.length) for r in corpus_pipeline.run(spark, d).collect())
    assert first == sorted((str(r.doc_id), r.piece, r.length) for r in corpus_pipeline.run(spark, d).collect())
    assert corpus_pipeline.run(spark, cases.stored(cases.empty(spark), tmp_path / "e")).count() == 0
