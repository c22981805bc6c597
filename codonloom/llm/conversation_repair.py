"""Operator 12: repair of conversations by Four-Russians block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.llm.common import SPACE, split_join, table

#: Symbols that one lookup takes.
BLOCK = 4

# States of the role pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
#: The state after a turn of a class (system, user, assistant, other); -1: not allowed.
_AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The state after an inserted or renamed turn: a user's, but after one an assistant's.
_NEXT = np.array([2, 2, 3, 2])
_ENDS = np.array([True, False, False, True])
_CLASSES = "suao"
#: Symbols: class and truncation (0 to 7), a turn that must go, and the end's padding.
_GOES, _PAD = 8, 9
_SYMBOLS = 10
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_FAR = 1 << 20


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs by state when turns may be inserted first."""
    for _ in range(3):
        cost = np.minimum(cost, INSERT + cost[_NEXT])
    return cost


def before(symbol: int, after: np.ndarray) -> np.ndarray:
    """The least cost to the end by state before a turn, from that after it."""
    if symbol == _PAD:
        return after
    cost = DELETE + after
    if symbol != _GOES:
        kind, cut = divmod(symbol, 2)
        to = _AFTER[:, kind]
        cost = np.minimum(cost, np.where(to >= 0, cut * TRUNCATED + after[to], _FAR))
        cost = np.minimum(cost, RENAME + cut * TRUNCATED + after[_NEXT])
    return with_inserts(cost)


@lru_cache(maxsize=1)
def steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, to, added): every cost vector that can arise, its least cost taken off,
    the first of them that of the end; and for each of them and each symbol the number
    of the vector before that symbol, with what was taken off it."""
    end = with_inserts(np.where(_ENDS, 0, _FAR))
    number, vectors, to, added = {tuple(end): 0}, [end], [], []
    for v in vectors:  # grows meanwhile
        found = [before(s, v) for s in range(_SYMBOLS)]
        for g in found:
            key = tuple(g - g.min())
            if key not in number:
                number[key] = len(vectors)
                vectors.append(g - g.min())
        to.append([number[tuple(g - g.min())] for g in found])
        added.append([int(g.min()) for g in found])
    return np.array(vectors), np.array(to), np.array(added)


@lru_cache(maxsize=1)
def blocks() -> tuple[np.ndarray, np.ndarray]:
    """(to, added) as in steps(), for every block of BLOCK symbols: a block's number has
    its first symbol as the highest digit."""
    _, to1, added1 = steps()
    to, added = to1, added1
    for _ in range(BLOCK - 1):
        longer, more = to1[to], added1[to] + added[:, :, None]  # vector, block, symbol before it
        to, added = (x.transpose(0, 2, 1).reshape(len(to1), -1) for x in (longer, more))
    return to, added


@lru_cache(maxsize=1 << 18)
def expanded(block: int, end: int, state: int) -> tuple[str, int]:
    """The edits of a block and the state after it: from the vector after the block back
    to that before each symbol, then forward, taking of the cheapest edits the first
    in the order D, I, K, R."""
    vectors, to, added = steps()
    symbols = [block // _SYMBOLS**k % _SYMBOLS for k in reversed(range(BLOCK))]
    ends = [end]
    for s in reversed(symbols):
        ends.append(int(to[ends[-1], s]))
    ends.reverse()
    edits = ""
    for i, s in enumerate(symbols):
        if s == _PAD:
            break
        after, now = vectors[ends[i + 1]], vectors[ends[i]] + added[ends[i + 1], s]
        while now[state] != DELETE + after[state] and now[state] == INSERT + now[_NEXT[state]]:
            edits, state = edits + "I", int(_NEXT[state])
        if now[state] == DELETE + after[state]:
            edits += "D"
            continue
        kind, cut = divmod(s, 2)
        kept = int(_AFTER[state, kind])
        if kept >= 0 and now[state] == cut * TRUNCATED + after[kept]:
            edits, state = edits + "K", kept
        else:
            edits, state = edits + "R", int(_NEXT[state])
    return edits, state


def cheapest(symbols: bytes) -> tuple[int, str]:
    """The least cost of a conversation's symbols, and of the edits of that cost those
    that come first as text. Blocks are looked up from the last to the first; then
    traced from the first to the last, expanding each from the vector after it."""
    vectors, _, _ = steps()
    to, added = blocks()
    padded = np.frombuffer(symbols + bytes([_PAD]) * (-len(symbols) % BLOCK), np.uint8).reshape(-1, BLOCK)
    codes = (padded @ (_SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()
    ends, now, cost = [0] * len(codes), 0, 0
    for i in range(len(codes) - 1, -1, -1):
        ends[i] = now
        cost += int(added[now, codes[i]])
        now = int(to[now, codes[i]])
    cost += int(vectors[now][0])
    pieces, state = [], 0
    for code, end in zip(codes, ends):
        piece, state = expanded(code, end, state)
        pieces.append(piece)
    while not _ENDS[state]:
        pieces.append("I")
        state = int(_NEXT[state])
    return cost, "".join(pieces)


def damaged(conversations: DataFrame) -> DataFrame:
    """_conv, _key, turn, role, text, alive: the rows with their damage by the hash of
    ``conv_id:turn``; a null is one space. Dropped rows stay, not alive."""
    conv, turn = F.col("conv_id"), F.col("turn")
    key = F.coalesce(conv.cast("string"), F.lit(" "))
    harm = F.crc32(F.concat_ws(":", key, F.coalesce(turn.cast("string"), F.lit(" ")))) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        conv.alias("_conv"), key.alias("_key"), turn.alias("turn"),
        F.when(harm == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (harm != 0).alias("alive"), F.explode(F.sequence(F.lit(1), F.when(harm == 3, 2).otherwise(1))).alias("_again"),
    ).drop("_again")


def faults(rows: DataFrame) -> DataFrame:
    """rows with _sha (of role and text), _class (of the role's initial) and _fault: b(lank),
    t(runcated) or nothing. ``rows``: as damaged() makes them."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    initial = F.left("role", F.lit(1))
    return rows.withColumns({
        # The role's length keeps two pairs apart that read alike when joined.
        "_sha": F.unhex(F.sha2(F.concat_ws(":", F.length("role"), F.concat("role", "text")), 256)),
        "_class": F.when(initial.isin(*_CLASSES[:3]), initial).otherwise(_CLASSES[3]),
        "_fault": F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise(""),
    })


def first_turns(rows: DataFrame) -> DataFrame:
    """rows with _late: whether an earlier turn of the conversation has the same role and
    text. One row a task and text is shuffled, and hot texts are split in the join."""
    place: Column = F.struct(F.col("turn").isNotNull().alias("n"), F.col("turn").alias("t"))
    first = rows.filter("alive").groupBy("_key", "_sha").agg(F.min(place).alias("_first"))
    return split_join(rows, first, ["_key", "_sha"], "left").withColumn("_late", ~F.col("turn").eqNullSafe(F.col("_first.t"))).drop("_first")


class Conversation:
    """One conversation as its rows stream by: first all its symbols, in order, then its texts."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.symbols = conv, bytearray()
        self.count = {"b": 0, "d": 0, "t": 0}
        self.illegal = self.turns = 0
        self.least = self.most = self.before = self.kind = None
        self.audit = None
        self.sha = hashlib.sha256()

    def turn(self, turn: int | None, sha: bytes, kind: str, fault: str, late: bool) -> None:
        if turn is not None and (self.most is None or turn != self.most):
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        if fault != "b" and (late or self.before == (turn, sha)):
            fault = "d"
        self.before = (turn, sha)
        if fault:
            self.count[fault] += 1
        if self.kind:
            self.illegal += self.kind + kind not in {"su", "ua", "au"}
        self.kind = kind
        self.symbols.append(_GOES if fault in {"b", "d"} else 2 * _CLASSES.index(kind) + (fault == "t"))

    def solve(self) -> None:
        self.cost, self.audit = cheapest(bytes(self.symbols))
        self.symbols = bytearray()
        self.edits = self.state = self.lines = 0  # edits done

    def line(self, role: str, text: str, state: int) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines, self.state = self.lines + 1, state

    def named(self, text: str) -> None:
        state = int(_NEXT[self.state])
        self.line("user" if state == 2 else "assistant", text, state)

    def insert(self) -> None:
        while self.edits < len(self.audit) and self.audit[self.edits] == "I":
            self.edits += 1
            self.named("")

    def text(self, role: str, kind: str, text: str) -> None:
        if self.audit is None:
            self.solve()
        self.insert()
        edit = self.audit[self.edits]
        self.edits += 1
        if edit == "K":
            self.line(role, text, int(_AFTER[self.state, _CLASSES.index(kind)]))
        elif edit == "R":
            self.named(text)

    def row(self) -> tuple:
        if self.audit is None:
            self.solve()
        self.insert()
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return self.conv, gaps, self.count["b"], self.count["d"], self.count["t"], self.illegal, self.cost, self.audit, self.sha.hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TYPES = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RESULT.split(", ")])


def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation, from rows sorted by conversation, symbols before texts."""
    now, key = None, None
    for batch in batches:
        done = []
        for k, conv, is_text, alive, turn, sha, kind, fault, late, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or k != key:
                if now:
                    done.append(now.row())
                now, key = Conversation(conv), k
            if not alive:
                continue
            if is_text:
                now.text(role, kind, text)
            else:
                now.turn(turn, sha, kind, fault, late)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(_TYPES.names, r)) for r in done], schema=_TYPES)
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip(_TYPES.names, now.row()))], schema=_TYPES)


def repairs(rows: DataFrame) -> DataFrame:
    """A row a conversation with its faults, the cheapest repair and a digest of the
    repaired text. ``rows``: as damaged() makes them; rows not alive only name their
    conversation.

    Every row goes to its conversation's task twice: as one symbol, and with its text.
    Symbols come first, so the edits are known before the texts, which are hashed as
    they pass and never held. What a task holds of a conversation is a byte a turn and
    the edits, which are one value of the result anyway. SHA-256 of a conversation has
    to be taken in order; that is why its texts pass one task. Texts equal to earlier
    ones are found beforehand, by a grouping that no hot text or conversation gathers.

    Nulls: see damaged(); null turns come first; a null conv_id is a conversation of its
    own. Empty and very long texts: whole. Ties in turn: by role, then by the SHA-256 of
    role and text; of repeated rows all but the first are duplicates. Roles other than
    system, user and assistant are known by their initial; one without any must be
    renamed or deleted. Empty table: empty result. Other columns: not read.
    """
    known = faults(rows)
    columns = ["_key", "_conv", "_text", "alive", "turn", "_sha", "_class", "_fault", "_late", "role", "text"]
    light = first_turns(known.drop("text")).withColumns({"_text": F.lit(False), "text": F.lit(None).cast("string")})
    full = known.filter("alive").withColumns({"_text": F.lit(True), "_late": F.lit(None).cast("boolean")})
    order = ["_key", "_text", F.col("turn").asc_nulls_first(), "role", "_sha"]
    # The role sorts a symbol as it sorts its text.
    return light.select(*columns).union(full.select(*columns)).repartition("_key").sortWithinPartitions(*order).mapInArrow(stream, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def sql_crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bit = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda y: CAST(ascii(y) AS BIGINT)), lambda c, b: {bit}, CAST(4294967295 AS BIGINT)), 4294967295)"


def sql() -> str:
    """A plain fold of the turns, from the first to the last: for each state the cheapest
    edits so far, the first as text of equally cheap ones, with the text they repair."""
    start, far = ("{'k': '%s', 'r': CAST(NULL AS VARCHAR)}" % (digit * 9) for digit in "09")

    def then(x: str, cost: str, edit: str, line: str | None) -> str:
        """x with an edit more; a state that nothing reaches stays so."""
        line = "{x}.r" if line is None else f"coalesce({{x}}.r || chr(10), '') || {line}"
        return f"CASE WHEN {x}.k < '9' THEN {{'k': lpad(CAST(CAST(left({x}.k, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}.k, 10) || '{edit}', 'r': {line.format(x=x)}}} ELSE {far} END"

    def least(*xs: str) -> str:
        return f"list_sort([{', '.join(xs)}])[1]"

    def kept(x: str, initial: str) -> str:
        return f"CASE WHEN i = '{initial}' AND NOT gone THEN {then(x, 'cut', 'K', 'line')} ELSE {far} END"

    def named(x: str, role: str) -> str:
        return f"CASE WHEN NOT gone THEN {then(x, '(2 + cut)', 'R', f"'{role}:' || text")} ELSE {far} END"

    def inserted(x: str, role: str) -> str:
        return then(x, "2", "I", f"'{role}:'")

    step = ", ".join([
        then("q0", "3", "D", None) + " AS p0", least(then("q1", "3", "D", None), kept("q0", "s")) + " AS p1",
        least(then("q2", "3", "D", None), kept("q0", "u"), kept("q1", "u"), kept("q3", "u"), named("q0", "user"), named("q1", "user"), named("q3", "user")) + " AS p2",
        least(then("q3", "3", "D", None), kept("q2", "a"), named("q2", "assistant")) + " AS p3",
    ])
    into2 = least("p2", inserted("p0", "user"), inserted("p1", "user"), inserted("p3", "user"))
    return rf"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {sql_crc32("concat_ws(':', coalesce(CAST(conv_id AS VARCHAR), ' '), coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS harm FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
  CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS again
  FROM h WHERE harm <> 0),
o AS (SELECT *, row_number() OVER w AS n, left(role, 1) AS i,
  lag(left(role, 1)) OVER w AS before, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text))),
f AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
t AS (SELECT conv_id, n, text, i, role || ':' || text AS line, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut FROM f),
r AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS n, {then(start, '0', '', None)} AS q0, {inserted(start, 'user')} AS q2, {far} AS q1, {far} AS q3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n + 1, p0, {into2}, p1, {least("p3", inserted(into2, "assistant"))}
  FROM (SELECT r.conv_id, r.n, {step} FROM r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.n = r.n)),
e AS (SELECT conv_id, list_sort([q0, q3, {inserted('q2', 'assistant')}])[1] AS b FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate,
  count_if(fault = 't') AS truncated, count_if(before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(left(b.k, 9) AS BIGINT) AS cost, substr(b.k, 10) AS audit, sha256(coalesce(b.r, '')) AS repaired_sha256
FROM e LEFT JOIN s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""


SQL = sql()
