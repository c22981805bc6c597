"""Commands of a text, with comments of any depth and quotes of any length."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"['\[\];]")


def pieces(text: str, keep: str) -> list[tuple[str, str]]:
    """(raw, bare) of each command that a semicolon ends, and of what follows the last.

    A semicolon, quote or bracket inside a comment means nothing but for brackets, which
    nest; inside quotes none means anything. bare has no comments; raw keeps ``all`` or,
    with ``notes``, those that begin with &. One pass from mark to mark; a comment or a
    quote without an end is an error."""
    found: list[tuple[str, str]] = []
    raw: list[str] = []
    bare: list[str] = []
    depth = raw_at = bare_at = 0
    quoted = kept = False
    for m in _MARK.finditer(text):
        c, i = m[0], m.start()
        if depth:
            depth += (c == "[") - (c == "]")
            if not depth:
                bare_at = i + 1
                raw_at = raw_at if kept else i + 1
        elif c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c == "[":
            depth, kept = 1, keep == "all" or text.startswith("[&", i)
            bare.append(text[bare_at:i])
            if not kept:
                raw.append(text[raw_at:i])
        elif c == ";":
            last = text[raw_at:i]
            found.append(("".join([*raw, last]), "".join([*bare, text[bare_at:i]])) if raw or bare else (last, last))
            raw, bare, raw_at, bare_at = [], [], i + 1, i + 1
    if depth or quoted:
        raise ValueError("a comment has no end" if depth else "a quote has no end")
    raw.append(text[raw_at:])
    bare.append(text[bare_at:])
    if any(raw):
        found.append(("".join(raw), "".join(bare)))
    return found


def command_pieces(keep: str):
    """A column function of text: an array of structs raw and bare, see pieces()."""

    @F.pandas_udf("array<struct<raw:string,bare:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"raw": r, "bare": b} for r, b in pieces(t, keep)])

    return run


#: So many characters of commands, or one command, leave a task at once.
SENT = 4_000_000


def command_rows(files: DataFrame, keep: str) -> DataFrame:
    """(file, text) to (file, pos, raw, bare), a row a command, see pieces(). A task holds the
    pieces of one text at a time, not those of all its texts."""
    kind = pa.schema([("file", pa.string()), ("pos", pa.int32()), ("raw", pa.string()), ("bare", pa.string())])

    def sent(file: str, first: int, part: list[tuple[str, str]]) -> pa.RecordBatch:
        columns = [[file] * len(part), range(first, first + len(part)), [r for r, _ in part], [b for _, b in part]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types)], schema=kind)

    def run(batches):
        for batch in batches:
            for file, text in zip(batch["file"], batch["text"]):
                found = pieces(text.as_py(), keep) if text.is_valid else []
                first = size = 0
                for k, (raw, bare) in enumerate(found):
                    size += len(raw) + len(bare)
                    if size >= SENT or k == len(found) - 1:
                        yield sent(file.as_py(), first, found[first : k + 1])
                        first, size = k + 1, 0

    return files.select("file", "text").mapInArrow(run, "file string, pos int, raw string, bare string")
