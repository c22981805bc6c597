"""Operator 1: URL filter by the ratio of two character language models.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonloom.llm.common import cut, small, table

#: (verdict, host, path): a rule fits its host, all subdomains, and paths that start with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters that models tell apart; every other counts as one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_"
OTHER, START = "¤", "¦"
ORDER = 3
#: Characters of a string that are taken apart in one row.
STRIP = 256
#: Grams are at most this many, whatever the input: the alphabet, other and start, to the power of order + 1.
MOST_GRAMS = (len(ALPHABET) + 2) ** (ORDER + 1)
#: One more than the most grams (about 100 bytes each in memory) that are broadcast; more are shuffled.
BROADCAST_GRAMS = 500_000


def host_of(url: Column) -> Column:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    return F.when(has, F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    return F.when(has, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams_of(strings: DataFrame, keep: list[str]) -> DataFrame:
    """A row (keep, gram) for each character of ``s``: the gram is the character with
    the ORDER before it, padded at the start, over the reduced alphabet; A-Z count as
    a-z. A string is first cut into strips that overlap by ORDER characters, so no row
    holds more than a strip and the work is linear in a string's length."""
    reduced = F.regexp_replace(F.translate("s", UPPER, LOWER), f"[^{ALPHABET.replace('-', chr(92) + '-')}]", OTHER)
    parts = F.regexp_extract_all(reduced, F.lit(f"(?s).{{1,{STRIP}}}"), F.lit(0))
    before = F.concat(F.array(F.lit(START * ORDER)), F.transform("_parts", lambda x: F.right(F.concat(F.lit(START * ORDER), x), F.lit(ORDER))))
    strips = F.zip_with(F.slice(before, F.lit(1), F.size("_parts")), "_parts", lambda a, b: F.concat(a, b))
    return (
        strings.select(*keep, parts.alias("_parts"))
        .select(*keep, F.explode(strips).alias("_strip"))
        .select(*keep, "_strip", F.explode(F.sequence(F.lit(1), F.length("_strip") - ORDER)).alias("_at"))
        .select(*keep, F.expr(f"substring(_strip, _at, {ORDER + 1})").alias("gram"))
    )


def log_ratios(labelled: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, llr) for each gram in wanted: ln p(character | context, accepted) minus
    the same for rejected.

    labelled: (gram, accepted, n). A model of each class: contexts of 0 to ORDER
    characters; a context gives its character the share n / (n + t) of counts, t
    its distinct followers, and t / (n + t) of the next shorter context's estimate
    (Witten-Bell); below order 0, a uniform share.
    """
    out = wanted.select("gram", F.explode(F.array(F.lit(True), F.lit(False))).alias("accepted"))
    p = F.lit(1.0 / (len(ALPHABET) + 1))
    for k in range(ORDER + 1):
        ctx, gram = f"substring(gram, {ORDER - k + 1}, {k})", f"substring(gram, {ORDER - k + 1}, {k + 1})"
        counts = labelled.groupBy("accepted", F.expr(ctx).alias(f"c{k}"), F.expr(gram).alias(f"g{k}")).agg(F.sum("n").alias(f"n{k}"))
        sums = counts.groupBy("accepted", f"c{k}").agg(F.sum(f"n{k}").alias(f"s{k}"), F.count(F.lit(1)).alias(f"t{k}"))
        out = (
            out.withColumns({f"c{k}": F.expr(ctx), f"g{k}": F.expr(gram)})
            .join(counts.drop(f"c{k}"), ["accepted", f"g{k}"], "left")
            .join(sums, ["accepted", f"c{k}"], "left")
        )
        n, s, t = (F.coalesce(F.col(f"{x}{k}"), F.lit(0)) for x in "nst")
        p = F.when(s > 0, (n + t * p) / (s + t)).otherwise(p)
        out = out.withColumn("_p", p).drop(f"c{k}", f"g{k}", f"n{k}", f"s{k}", f"t{k}")
        out = out.withColumnRenamed("_p", f"p{k}").drop(f"p{k - 1}")
        p = F.col(f"p{k}")
    signed = F.when(F.col("accepted"), F.log(p)).otherwise(-F.log(p))
    return out.groupBy("gram").agg(F.sum(signed).alias("llr"))


def mean_ratio(strings: DataFrame, ratios: DataFrame) -> DataFrame:
    """(k, llr): the log-likelihood difference of each string, per character."""
    scored = grams_of(strings.select("k", "s"), ["k"]).join(ratios, "gram")
    return scored.groupBy("k").agg(F.avg("llr").alias("llr"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Verdicts on every url: the longest fitting rule's, else the method's.

    Urls that rules accept and reject train the two models; each distinct host and
    path counts once, so a hot host weighs by its pages' variety. Half of them, by
    hash, fits the models that judge; the other half calibrates their threshold, the
    point between the two classes' mean ratios at equal standard deviations.

    Adds host, path, rule, verdict and llr (the mean ratio, null for an empty url).
    Null url, or one without ``://``: host and path empty, no rule. An empty host
    and path has no evidence: allow. If rules accept or reject nothing in either
    half, there is nothing to compare: allow. Very long urls: whole. Ties: a ratio at
    the threshold is allowed; of rules the longest wins. Repeated rows: each on its
    own. Null ids: as any other. Empty table: empty result. Other columns: not read,
    so their names don't matter.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    base = base.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    whole = F.concat("host", "path")
    # 128 bits stand for a string in groupings and joins.
    base = base.select("page_id", "host", "path", rule.alias("rule"), says.alias("_says"), whole.alias("s"), F.unhex(F.md5(whole)).alias("k"))
    distinct = cut(base.groupBy("k").agg(F.first("s").alias("s"), F.first("_says", ignorenulls=True).alias("_says")))
    base = base.drop("s")
    ruled = distinct.filter(F.col("_says").isNotNull()).select("k", "s", (F.col("_says") == "allow").alias("accepted"), (F.xxhash64("s") % 2 == 0).alias("half"))
    counted = cut(grams_of(ruled.filter("half"), ["accepted"]).groupBy("gram", "accepted").agg(F.count(F.lit(1)).alias("n")), MOST_GRAMS)
    scores, threshold = distinct.select("k", F.lit(None).cast("double").alias("llr")).filter("false"), 0.0
    if counted.select("accepted").distinct().count() == 2:
        grams = grams_of(distinct, []).groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
        ratios = cut(log_ratios(counted, grams), MOST_GRAMS)
        ratios = small(ratios, ratios.count(), BROADCAST_GRAMS)
        shown = mean_ratio(ruled.filter("not half"), ratios).join(ruled, "k")
        stats = {r["accepted"]: r for r in shown.groupBy("accepted").agg(F.avg("llr").alias("m"), F.coalesce(F.stddev("llr"), F.lit(0.0)).alias("d")).collect()}
        if len(stats) == 2:
            a, b = stats[True], stats[False]
            spread = a["d"] + b["d"]
            threshold = (a["m"] * b["d"] + b["m"] * a["d"]) / spread if spread > 0 else (a["m"] + b["m"]) / 2
            scores = mean_ratio(distinct, ratios)
    judged = base.join(scores, "k", "left")
    verdict = F.coalesce("_says", F.when(F.col("llr") < threshold, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "llr")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, llr for each page."""
    return filter_urls(table(spark, sf_dir, "pages"))
