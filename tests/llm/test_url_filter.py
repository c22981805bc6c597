import math
import re
import statistics
from collections import Counter

from pyspark.sql import functions as F

from codonloom.llm.url_filter import ALPHABET, ORDER, OTHER, RULES, START, filter_urls, grams_of, log_ratios, query


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    return "".join(c.lower() if c < "\x80" else c for c in m[1]), m[2]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def tables(counts):
    """For each order, the counts of grams, and the sum and number of them for each context."""
    out = []
    for k in range(ORDER + 1):
        grams, sums, kinds = Counter(), Counter(), Counter()
        for g, n in counts.items():
            grams[g[ORDER - k :]] += n
        for g, n in grams.items():
            sums[g[:-1]] += n
            kinds[g[:-1]] += 1
        out.append((grams, sums, kinds))
    return out


def p(gram, orders):
    out = 1 / (len(ALPHABET) + 1)
    for k, (grams, sums, kinds) in enumerate(orders):
        s, t = sums[gram[ORDER - k : ORDER]], kinds[gram[ORDER - k : ORDER]]
        out = (grams[gram[ORDER - k :]] + t * out) / (s + t) if s else out
    return out


def test_query_follows_the_rules(spark, sf):
    urls = dict(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect())
    rows = query(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        want, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_models_equal_brute_force(spark):
    grams = {True: Counter({"abca": 3, "abcb": 1, "bcab": 2}), False: Counter({"abcb": 2, "cccc": 1})}
    rows = [(g, a, n) for a, c in grams.items() for g, n in c.items()]
    wanted = ["abca", "abcb", "zzzz", "cabb"]
    got = dict(log_ratios(spark.createDataFrame(rows, "gram string, accepted boolean, n long"), spark.createDataFrame([(g,) for g in wanted], "gram string")).collect())

    for g in wanted:
        assert math.isclose(got[g], math.log(p(g, tables(grams[True])) / p(g, tables(grams[False]))), rel_tol=1e-9)


def test_threshold_and_verdicts_equal_brute_force(spark, sf):
    urls = dict(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect())
    texts = {"".join(parts(u)) for u in urls.values()}
    half = {r.s: r.h for r in spark.createDataFrame([(t,) for t in texts], "s string").selectExpr("s", "xxhash64(s) % 2 = 0 h").collect()}
    says = {"".join(parts(u)): rule(*parts(u))[1] for u in urls.values()}

    def grams(text):
        text = START * ORDER + "".join(c if c in ALPHABET else OTHER for c in re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return [text[i : i + ORDER + 1] for i in range(len(text) - ORDER)]

    models = [tables(Counter(g for t in texts if says[t] == v and half[t] for g in grams(t))) for v in ("allow", "block")]

    def score(text):
        return statistics.fmean(math.log(p(g, models[0]) / p(g, models[1])) for g in grams(text))

    (ma, da), (mb, db) = ((statistics.fmean(x), statistics.stdev(x)) for x in ([score(t) for t in texts if says[t] == v and not half[t]] for v in ("allow", "block")))
    threshold = (ma * db + mb * da) / (da + db)
    judged = 0
    for r in query(spark, sf).collect():
        text = "".join(parts(urls[r.page_id]))
        if text:
            assert math.isclose(r.llr, score(text), rel_tol=1e-6, abs_tol=1e-9)
        if r.rule is None and text:
            judged += 1
            assert r.verdict == ("block" if score(text) < threshold else "allow")
    assert judged > 10


def test_learns_and_handles_awkward_urls(spark):
    rows = [(i, f"http://good{i % 40}.com/aaa/bab{i}", "u") for i in range(80)] + [(100 + i, f"http://x{i % 40}.net/es/zzqzq{i}", "u") for i in range(80)]
    rows += [(900, "http://w.org/aaa/bab7", None), (901, "http://w.org/zzqzqz", None)]
    rows += [(902, None, None), (903, "nothing", None), (904, "://", None), (None, "HTTP://Ä.Com?x", None), (905, "a://B.COM#/", None), (906, "http://" + "y" * 50_000, None)] * 2
    out = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, s string")).collect()}
    assert out[900].verdict == "allow" and out[901].verdict == "block"
    assert out[902].host == out[902].path == "" and out[902].verdict == "allow"
    assert out[905].host == "b.com" and out[905].path == "" and out[905].rule is None
    assert out[None].host == "Ä.com"
    df = spark.createDataFrame(rows, "page_id long, url string, s string")
    assert filter_urls(df).count() == len(rows)
    assert filter_urls(df.filter("false")).count() == 0
    assert OTHER not in ALPHABET and START not in ALPHABET


def test_one_very_long_url(spark):
    """Its grams are taken strip by strip: all of them, and no row holds more than a strip."""
    text = "ab" + "cd/" * 400_000 + "é"
    rows = grams_of(spark.createDataFrame([(text, 1), ("x", 2), ("", 3)], "s string, k int"), ["k"])
    got = {(r.k, r.gram): r.n for r in rows.groupBy("k", "gram").agg(F.count("*").alias("n")).collect()}
    padded = START * ORDER + text.replace("é", OTHER)
    want = Counter((1, padded[i : i + ORDER + 1]) for i in range(len(text)))
    assert got == {**want, (2, START * ORDER + "x"): 1}
