"""Long chains in blocks give the scores of whole chains."""

import pytest

from codonloom.operators.traces import autocorrelation, ranked, window_scores


def test_blocks_of_a_chain(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, c, p, float(rng.standard_normal())) for c in range(2) for p, n in (("a", 300), ("b", 257), ("c", 30)) for i in range(n)]
    rows += [(5000, 0, "a", None)]
    df = spark.createDataFrame(rows, "iteration long, chain int, param string, value double").repartition(5)
    assert {(r.chain, r.param, r.pos): r.value for r in ranked(df).collect()} == {(c, p, i + 1): v for i, c, p, v in rows[:-1]}
    for block in (7, 50, 1024):
        got = {(r.chain, r.pos): (r.score, r.n_params) for r in autocorrelation(df, block=block).collect()}
        for c in range(2):
            score, count = window_scores([np.array([v for _, d, q, v in rows[:-1] if (d, q) == (c, p)]) for p in "abc"], 25)
            assert [got[c, i + 25] for i in range(len(score))] == [(pytest.approx(s), n) for s, n in zip(score, count, strict=True)]
        assert len(got) == 2 * 276
