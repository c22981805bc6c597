"""Awkward documents for every operator on texts."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, _rid string, gram int, _id string, _s long, rid string, k int, `a.b` int"

TEXTS = [
    None,
    "",
    " \n\t",
    "a",
    "...",
    "one two three four five six seven eight nine ten",
    "one two three  four five six seven eight nine ten",
    "x" * 300_000,
    "word " * 60_000,
    "Ünïcödé 日本語 text ¤ ¦ with 😀 emoji",
    "at 1.2.3." + "0" * 5000 + "1, " + "0" * 5000 + ".0.0.255 and +1 " + "9" * 20_000,
    "http://a.example.net/" + "es/" * 20_000,
    "mail a.b+c@d-e.co.uk, or x@y, 10.0.0.255 and 1.2.3.256; +1 (509) 555-6973",
]


def rows():
    """Each text twice, once as a repeated row; nulls in every column; clashing extra columns."""
    out = []
    for i, t in enumerate(TEXTS):
        for again in (0, 0, 100):
            out.append((i + again, t, ["en", None, "fr"][i % 3], ["b", None, "a"][i % 3], None, "size", i, "rid", None, f"id{i}", i, f"rid{i}", i, i))
    out.append((None,) * 14)
    out.append((None, "one two three four five six seven eight nine ten", *[None] * 12))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).coalesce(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def stored(df, path):
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def values(df):
    """All rows, with all columns, in an order of their own."""
    return sorted(map(repr, map(tuple, df.collect())))


def parallelism(spark, n):
    """Let scans be split as on n cores (None: as they are)."""
    if n is None:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    else:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(n))
