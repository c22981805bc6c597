import zlib
from collections import defaultdict

import cases
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codonloom.llm.packing import CAPACITY, cuts, default_tokenizer, encoder, fit_counts, pack, pack_lengths, patterns_of, query, slots_of


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aB's \n\t\x0b\x1c\x1f\x85\xa0 é1½٣字.<|>", max_size=60)))
def test_ids_equal_the_tokenizers_library(text):
    if not hasattr(test_ids_equal_the_tokenizers_library, "t"):
        test_ids_equal_the_tokenizers_library.t = Tokenizer.from_file(default_tokenizer())
    want = test_ids_equal_the_tokenizers_library.t.encode(text, add_special_tokens=False).ids
    assert encoder(default_tokenizer()).ids(text).tolist() == want


def test_added_tokens_in_a_text():
    t = Tokenizer.from_file(default_tokenizer())
    for text in ("a<|endoftext|>b", "<|endoftext|>", "x" * 5000, "ab " * 5000):
        assert encoder(default_tokenizer()).ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_cuts():
    assert cuts(1) == [(0, 1)] and cuts(2048) == [(0, 2048)] and cuts(2049) == [(0, 1), (1, 2048)]
    assert cuts(4096) == [(0, 2048), (2048, 2048)]


def valid(plan, h):
    cap, used = len(h) - 1, np.zeros(len(h), dtype=np.int64)
    for pattern, k in plan:
        assert k > 0 and sum(n * t for n, t in pattern) <= cap
        for n, t in pattern:
            used[n] += t * k
    assert (used == h).all()
    return sum(k for _, k in plan)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plans_pack_every_piece_near_the_bound(lengths):
    h = np.bincount(np.array(lengths, dtype=np.int64), minlength=33)
    n = valid(pack_lengths(h), h)
    assert n <= np.ceil(1.25 * sum(lengths) / 32) + sum(x > 16 for x in lengths) + 1


def test_large_histogram_is_nearly_full():
    rng = np.random.default_rng(1)
    h = np.bincount(np.minimum(rng.lognormal(6, 1, 300_000).astype(int) + 1, CAPACITY), minlength=CAPACITY + 1)
    n = valid(pack_lengths(h), h)
    assert n <= 1.002 * np.ceil((h * np.arange(len(h))).sum() / CAPACITY)


def test_fit_reduces_the_misfit():
    h = np.zeros(17, dtype=np.int64)
    h[[4, 5, 6, 7, 10, 12]] = [30, 20, 25, 10, 40, 30]
    p = patterns_of(h)
    assert (p.sum(axis=1) == 16).all()
    x = fit_counts(h, p)
    made = np.bincount(p.ravel(), weights=np.repeat(x, 3), minlength=17)
    made[0] = 0
    assert (x >= 0).all() and ((made - h) ** 2).sum() < 0.3 * (h**2).sum()
    assert len(slots_of([([(4, 4)], 2)], 16)["base"]) == 1


def check(rows, texts):
    t = Tokenizer.from_file(default_tokenizer())
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    for doc, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        got = {r.piece: r for r in by_doc[doc] if r.ids_crc32 is not None}
        for piece, (start, n) in enumerate(cuts(len(ids))):
            own = np.array(ids[start : start + n], dtype="<u4").tobytes()
            assert any((r.start, r.length, r.ids_crc32) == (start, n, zlib.crc32(own)) for r in by_doc[doc] if r.piece == piece), (doc, got)
    return len(by_seq)


def test_query_packs_every_document(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = query(spark, sf).collect()
    n = check(rows, texts)
    assert n <= 1.03 * np.ceil(sum(r.length for r in rows) / CAPACITY) + 1


def test_awkward_rows(spark, tmp_path):
    d = cases.stored(cases.documents(spark), tmp_path)
    rows = query(spark, d).collect()
    check(rows, [(r[0], r[1]) for r in cases.rows()])
    ids = pack(spark.read.parquet(f"{d}/documents.parquet"), with_ids=True).collect()
    assert len(ids) == len(rows) and all(len(r.ids) == r.length for r in ids)
    assert pack(cases.empty(spark)).count() == 0
