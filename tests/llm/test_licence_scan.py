import re

import cases
import numpy as np
import pytest

from codonloom.llm.licence_scan import DICE, Templates, known, query
from codonloom.llm.licence_texts import notices, templates, whole_texts


def gram_set(text):
    w = re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()
    return set(zip(w, w[1:], strict=False))


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_query_equals_brute_force_over_lines(spark):
    """Every line of every document against every template."""
    d = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    sets = [(i, gram_set(t)) for i, t in templates()]
    found = 0
    for r in query(spark, d).collect():
        lines = texts[r.doc_id].split("\n")
        want = set()
        for line in lines:
            if re.search("(?i)licen|spdx|CC", line):
                scores = [(dice(gram_set(line), s), i) for i, s in sets]
                if max(scores)[0] >= DICE:
                    want.add(max(scores, key=lambda x: x[0])[1])
        assert set(r.licences.split(",")) - {""} == want, r
        found += len(want)
        for span in filter(None, r.spans.split(",")):
            i, a, b = span.rsplit(":", 2)
            passage = texts[r.doc_id].encode()[int(a) : int(b)].decode()
            assert max(dice(gram_set(passage), s) for j, s in sets if j == i) >= DICE
    assert found > 3


def test_whole_templates_inside_text():
    for spdx, text in [*whole_texts()[:5], *notices()[:12]]:
        raw = f"Some words before it. And more of them!\n\n{text}\nThe end of the file, with words after it."
        got = known().matches(raw.encode())
        assert [g[2] for g in got] == [spdx], got
        at = raw.encode().decode()[got[0][0] : got[0][1]]
        assert at.split()[0] == text.split()[0] and got[0][3] > 0.97


def test_whole_licence_files():
    """Files of the common licences, set anew in lines of another width, with a few words changed."""
    files = whole_texts()[5:]
    assert len(files) == 13
    for spdx, text in files:
        words = text.split()
        words[10:12] = ["changed", "words"]
        lines = [" ".join(words[i : i + 11]) for i in range(0, len(words), 11)]
        raw = "\n".join(["Copyright of somebody", *(f"# {x}" for x in lines), "Then something else"]).encode()
        got = known().matches(raw)
        assert [g[2] for g in got] == [spdx], (spdx, got)
        assert got[0][1] - got[0][0] > 0.9 * len(raw) and got[0][3] > 0.95


def test_passages_equal_brute_force():
    """The best passage from every line, all ends tried, with repeated words."""
    rng = np.random.default_rng(4)
    template = " ".join(f"t{i}" for i in rng.integers(0, 30, 40))
    known = Templates([("X", template)], dice=0.5)
    mine = gram_set(template)
    for _ in range(60):
        lines, at = [], 0
        while at < 40:
            n = int(rng.integers(1, 7))
            lines.append(" ".join(template.split()[at : at + n] if rng.random() < 0.7 else [f"t{i}" for i in rng.integers(0, 40, n)]))
            at += n
        best = []
        for i in range(len(lines)):
            scores = [dice(gram_set(" ".join(lines[i : e + 1])), mine) for e in range(i, len(lines))]
            best.append(max(scores))
        got = known.matches("\n".join(lines).encode())
        assert bool(got) == (max(best) >= 0.5)
        if got:
            assert max(g[3] for g in got) == pytest.approx(max(best))


def test_changed_and_clean_texts():
    mit = dict(whole_texts())["MIT"]
    words = mit.split()
    del words[10:14], words[60:63]
    assert [m[2] for m in known().matches(" ".join(words).encode())] == ["MIT"]
    assert known().matches(" ".join(words[:60]).encode()) == []
    assert known().matches(b"The license of the driver is provided as is, without the copyright notice of the author.") == []
    many = "Released under the MIT License.\n" * 3000
    assert len(known().matches(many.encode())) == 3000


def test_awkward_rows(spark, tmp_path):
    got = query(spark, cases.stored(cases.documents(spark), tmp_path)).collect()
    assert len(got) == len(cases.rows()) and all(r.n_matches == 0 for r in got)
    assert query(spark, cases.stored(cases.empty(spark), tmp_path / "e")).count() == 0
