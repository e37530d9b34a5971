"""Conversation structure repair: a min-plus dynamic program over runs of equal symbols.

A row's symbol is the initial of its role with its first fault.  Equal consecutive symbols are one run; a symbol's
min-plus transition over the four grammar states has its binary powers cached, so a run of n rows costs log n products.
The runs give the least cost; unrolling them by halves of those powers gives the edits, the ASCII-least among the cheapest.

Rows pass Python as sorted streams: of a conversation a task holds its runs and its audit, one letter a row, never its
texts.  A conversation's rows are dealt by ranges of ``CHUNK`` turn numbers, so a hot conversation is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelens.llm.common import SPACE, quoted
from lodgelens.session import StoredTables

CHUNK = 4096  # turn numbers whose rows one task takes together
RUN_BYTES = 1 << 20  # output is handed on in batches of about this size

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED_COST = 5
FAULTS = ("none", "blank", "duplicate", "truncated")
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

# Grammar states: at the start, behind the system turn, behind a user turn, behind an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state behind an inserted or reroled row
NAMES = ("", "system", "user", "assistant")  # the role that leads into a state
MOST = 1 << 60
# Cost of the rows still to be inserted when the conversation has ended in a state.
ENDS = (0, 2 * INSERT, INSERT, 0)
LEGAL = frozenset(("su", "ua", "au"))

Symbol = tuple[str, int]
Vector = tuple[int, ...]


# -- the dynamic program -----------------------------------------------------------------------------------


def edits(symbol: Symbol, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of the edits of one row, in ASCII order (inserts before the row not included)."""
    initial, fault = symbol
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    follows = {"s": SYSTEM if state == START else None, "u": USER if state != USER else None}
    follows["a"] = ASSISTANT if state == USER else None
    if follows.get(initial) is not None:
        yield "K", KEEP + extra, follows[initial]
    yield "R", REROLE + extra, NEXT[state]


@cache
def power(symbol: Symbol, k: int) -> tuple[Vector, ...]:
    """Least cost from state to state over 2^k rows of the symbol."""
    if k:
        half = power(symbol, k - 1)
        return tuple(
            tuple(min(half[i][m] + half[m][j] for m in range(4)) for j in range(4)) for i in range(4)
        )
    rows = []
    for state in range(4):
        row, at, paid = [MOST] * 4, state, 0
        for _ in range(4):  # none to three inserts reach every state there is
            for _, cost, after in edits(symbol, at):
                row[after] = min(row[after], paid + cost)
            at, paid = NEXT[at], paid + INSERT
        rows.append(tuple(row))
    return tuple(rows)


def _before(matrix: tuple[Vector, ...], after: Vector) -> Vector:
    return tuple(min(row[j] + after[j] for j in range(4)) for row in matrix)


def _bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def _row(symbol: Symbol, state: int, after: Vector, out: list[str]) -> int:
    ahead = _before(power(symbol, 0), after)
    while True:
        left = ahead[state]
        for letter, cost, reached in edits(symbol, state):
            if letter != "D" and INSERT + ahead[NEXT[state]] == left:  # I sorts behind D, before K and R
                break
            if cost + after[reached] == left:
                out.append(letter)
                return reached
        out.append("I")
        state = NEXT[state]


def _block(symbol: Symbol, k: int, state: int, after: Vector, out: list[str]) -> int:
    """Unroll 2^k rows of a symbol from ``state``; ``after`` is the cost behind them, by state."""
    if k == 0:
        return _row(symbol, state, after, out)
    middle = _before(power(symbol, k - 1), after)
    state = _block(symbol, k - 1, state, middle, out)
    return _block(symbol, k - 1, state, after, out)


def cheapest_edits(runs: list[list[tuple[str, int, int]]]) -> tuple[int, list[tuple[int, str]]]:
    """Least cost, and per chunk of runs ``(initial, fault, rows)`` its first state and its letters.

    Letters are K(eep), R(erole), D(elete), I(nsert); those of inserted rows stand before the row they precede, and
    rows inserted at the end belong to the last chunk.
    """
    runs = [[(i if i in ("s", "u", "a") else "", fault, n) for i, fault, n in chunk] for chunk in runs]
    flat = [((initial, fault), n) for chunk in runs for initial, fault, n in chunk]
    behind: list[Vector] = [ENDS]
    for symbol, n in reversed(flat):
        vector = behind[-1]
        for k in _bits(n):
            vector = _before(power(symbol, k), vector)
        behind.append(vector)
    behind.reverse()  # behind[i]: cost from run i on, by state
    state, number, pieces = START, 0, []
    for chunk in runs:
        first, out = state, []
        for initial, fault, n in chunk:
            symbol, blocks = (initial, fault), _bits(n)
            afters = [behind[number + 1]]
            for k in blocks[:-1]:
                afters.append(_before(power(symbol, k), afters[-1]))
            for k, after in zip(reversed(blocks), reversed(afters)):  # the largest block comes first
                state = _block(symbol, k, state, after, out)
            number += 1
        pieces.append((first, "".join(out)))
    if pieces:
        first, letters = pieces[-1]
        pieces[-1] = (first, letters + "I" * (ENDS[state] // INSERT))
    return behind[0][START], pieces


# -- rows ----------------------------------------------------------------------------------------------------


def _by_key(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Groups of a sorted stream by its first ``keys`` columns."""
    rows = (row for batch in batches for row in zip(*[column.to_pylist() for column in batch.columns]))
    return groupby(rows, key=itemgetter(*range(keys)) if keys > 1 else lambda row: (row[0],))


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size > RUN_BYTES:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def prepared(turns: DataFrame, key: str, order: str) -> DataFrame:
    """The rows with ``conv``, ``chunk``, ``turn``, ``role``, ``text`` and ``sha``, which orders rows of equal turn and role."""
    text = lambda name: F.coalesce(quoted(name).cast("string"), F.lit(" "))
    turn = quoted(order).cast("long")
    return turns.select(
        quoted(key).alias("conv"),
        F.coalesce(F.floor(turn / CHUNK), F.lit(-(2**62))).cast("long").alias("chunk"),
        turn.alias("turn"),
        text("role").alias("role"),
        text("text").alias("text"),
    ).withColumn("sha", F.sha2(F.concat(F.col("role"), F.lit("\x00"), F.col("text")), 256))


def with_faults(rows: DataFrame) -> DataFrame:
    """``initial`` and first ``fault`` of every prepared row, without its text."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    truncated = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    light = rows.select(
        "conv", "chunk", "turn", F.substring("role", 1, 1).alias("initial"), "role", "sha",
        blank.alias("blank"), truncated.alias("truncated"),
    )
    seen = F.row_number().over(Window.partitionBy("conv", "sha").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), BLANK).when(seen, DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(NONE)
    return light.select("conv", "chunk", "turn", "role", "sha", "initial", fault.alias("fault"))


def _summaries(schema: pa.Schema):
    def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv, chunk), group in _by_key(batches, 2):
                runs, faults = [], [0] * len(FAULTS)
                first = last = low = high = None
                illegal = turns = 0
                for _, _, turn, initial, fault in group:
                    if first is None:
                        first = initial
                    elif last + initial not in LEGAL:
                        illegal += 1
                    last = initial
                    faults[fault] += 1
                    if turn is not None:
                        turns += turn != high
                        low, high = turn if low is None else low, turn
                    if runs and runs[-1]["initial"] == initial and runs[-1]["fault"] == fault:
                        runs[-1]["n"] += 1
                    else:
                        runs.append({"initial": initial, "fault": fault, "n": 1})
                yield conv, chunk, runs, *faults[1:], illegal, first, last, low, high, turns

        return _batches(rows(), schema)

    return summaries


def _audits(schema: pa.Schema):
    def audits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv,), group in _by_key(batches, 1):
                chunks, runs, counts = [], [], [0, 0, 0, 0]
                last = low = high = None
                turns = 0
                for _, chunk, own, blank, duplicate, truncated, illegal, first, end, least, most, distinct in group:
                    if last is not None and last + first not in LEGAL:
                        illegal += 1
                    last = end
                    counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated, illegal))]
                    if least is not None:
                        low, high, turns = least if low is None else low, most, turns + distinct
                    chunks.append(chunk)
                    runs.append([(r["initial"], r["fault"], r["n"]) for r in own])
                cost, pieces = cheapest_edits(runs)
                gaps = 0 if low is None else high - low + 1 - turns
                parts = [{"chunk": c, "state": s, "letters": x} for c, (s, x) in zip(chunks, pieces)]
                yield conv, gaps, *counts, cost, "".join(x for _, x in pieces), parts

        return _batches(rows(), schema)

    return audits


def _repaired(schema: pa.Schema):
    def repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv, chunk), group in _by_key(batches, 2):
                _, _, _, _, _, state, letters = next(group)
                at = place = 0
                for _, _, kind, role, text, _, _ in _with_end(group):
                    while at < len(letters) and letters[at] == "I":
                        state = NEXT[state]
                        yield conv, chunk, place, NAMES[state], "", "I"
                        at, place = at + 1, place + 1
                    if kind is None:
                        break
                    letter = letters[at]
                    at += 1
                    if letter == "D":
                        continue
                    state = next(s for x, _, s in edits((role[:1], NONE), state) if x == letter)
                    yield conv, chunk, place, role if letter == "K" else NAMES[state], text, letter
                    place += 1

        return _batches(rows(), schema)

    return repaired


def _with_end(group: Iterator[tuple]) -> Iterator[tuple]:
    yield from group
    yield (None,) * 7


def _fields(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def audit_conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row per conversation: ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` and ``pieces`` (the audit by chunk of turn numbers, with the grammar state before it).

    Rows go by ``order`` (nulls first), then role, then a digest of role and text.  A row's first fault counts: blank (no
    character but blanks), duplicate (role and text stand in an earlier row; equal by SHA-256), truncated (the last
    such character is not one of ``.!?``).  The audit is the ASCII-least of the cheapest edits (Keep 0, Rerole 1,
    Delete 2, Insert 5, any undeleted truncated row 5 more) after which role initials read ``(s?(ua)+)?``; blank and
    duplicate rows must go.  Null roles and texts are one space, so a null text is blank; a role without an initial
    can be reroled or deleted, not kept; rows with a null key are one conversation; other columns are ignored and an
    empty table gives no rows.  A task holds one conversation's runs and audit, so an audit is bounded by 2 GB.
    """
    spark_key = turns.schema[key].dataType
    long, text = T.LongType(), T.StringType()
    run = _fields(("initial", text), ("fault", T.IntegerType()), ("n", long))
    piece = _fields(("chunk", long), ("state", T.IntegerType()), ("letters", text))
    summary = _fields(
        ("conv", spark_key), ("chunk", long), ("runs", T.ArrayType(run)), ("blank", long), ("duplicate", long),
        ("truncated", long), ("illegal", long), ("first", text), ("last", text), ("low", long), ("high", long), ("turns", long),
    )
    result = _fields(
        ("conv", spark_key), ("gaps", long), ("blank", long), ("duplicate", long), ("truncated", long),
        ("illegal", long), ("cost", long), ("audit", text), ("pieces", T.ArrayType(piece)),
    )
    marked = with_faults(prepared(turns, key, order))
    dealt = marked.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "turn", "role", "sha")
    chunks = dealt.select("conv", "chunk", "turn", "initial", "fault").mapInArrow(_summaries(_arrow(summary)), summary)
    ordered = chunks.repartition("conv").sortWithinPartitions("conv", "chunk")
    return ordered.mapInArrow(_audits(_arrow(result)), result)


def repaired_turns(turns: DataFrame, audits: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The repaired rows: ``conv``, ``chunk``, ``place`` (order within a chunk), ``role``, ``text``, ``edit``.

    ``audits`` is the result of :func:`audit_conversations` for the same rows.  Inserted rows have an empty text;
    deleted rows are not there.
    """
    text, whole = T.StringType(), T.IntegerType()
    schema = _fields(
        ("conv", turns.schema[key].dataType), ("chunk", T.LongType()), ("place", T.LongType()), ("role", text),
        ("text", text), ("edit", text),
    )
    none = lambda kind: F.lit(None).cast(kind)
    pieces = audits.select("conv", F.inline("pieces")).select(
        "conv", "chunk", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"),
        none("string").alias("text"), none("string").alias("sha"), "state", "letters",
    )
    rows = prepared(turns, key, order).select(
        "conv", "chunk", F.lit(1).alias("kind"), "turn", "role", "text", "sha",
        none(whole).alias("state"), none("string").alias("letters"),
    )
    dealt = pieces.unionByName(rows).repartition("conv", "chunk")
    ordered = dealt.sortWithinPartitions("conv", "chunk", "kind", "turn", "role", "sha")
    wanted = ordered.select("conv", "chunk", "kind", "role", "text", "state", "letters")
    return wanted.mapInArrow(_repaired(_arrow(schema)), schema)


def repair_conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> tuple[DataFrame, DataFrame]:
    """Audits and repaired rows of all conversations; the audits are stored once in the shared folder."""
    store = StoredTables(turns.sparkSession, "conversation-repair")
    audits = store.put(audit_conversations(turns, key, order), "audits")
    return audits, repaired_turns(turns, audits, key, order)


# -- what the query adds ---------------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32 of ``conv_id:turn``: rows dropped, emptied, cut, repeated or reroled."""
    said = lambda c: F.coalesce(c, F.lit(" "))
    code = F.crc32(F.concat(said(F.col("conv_id").cast("string")), F.lit(":"), said(F.col("turn").cast("string"))).cast("binary")) % 20
    role, text = said(F.col("role")), said(F.col("text"))
    spoilt = F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return turns.where(code != 0).select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(role).alias("role"),
        spoilt.alias("text"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv`` and SHA-256 of its repaired ``role:text``, newline-joined.

    A digest needs the rows one after the other, so a conversation's rows pass one task here, as a stream.
    """
    import hashlib

    schema = _fields(("conv", repaired.schema["conv"].dataType), ("sha", T.StringType()))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv,), group in _by_key(batches, 1):
                digest, between = hashlib.sha256(), ""
                for _, role, text in group:
                    digest.update(f"{between}{role}:{text}".encode())
                    between = "\n"
                yield conv, digest.hexdigest()

        return _batches(rows(), arrow)

    arrow = _arrow(schema)
    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "chunk", "place")
    return ordered.select("conv", "role", "text").mapInArrow(hashed, schema)
