"""Packing documents into training sequences by the sum-of-squares online rule.

A document is its token ids and an end id.  Whole windows of a long document become sequences at once; what is left
goes, as it comes, to the fill level that minimises the sum of squared numbers of partially filled windows per level
(Csirik et al., "On the Sum-of-Squares algorithm for bin packing"), read from a level array.  Each task packs its own
input in one pass without a shuffle; the windows still open at its end are cut and joined, so that at most one
sequence of a task is padded.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.common import text_of

WINDOW = 2048
END_ID = 1
CACHED_WORDS = 600_000
RESULT = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet of public BPE vocabularies: printable bytes stand for themselves, others follow 255."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    letters |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in letters)}
    return letters


class WordEncoder(dict):
    """Token ids of whole texts as little-endian bytes, word by word with a bounded cache (this dict).

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words.  A word of
    plain Latin letters with ASCII marks behind it is two such parts, and its letters go straight to the BPE
    model; any other word takes the whole tokenizer.  Texts with a special string are encoded in one piece.
    """

    LETTERS = re.compile("([a-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff]+)([!#$%&*+,./:;=?|-]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words are cached here
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = _byte_letters()

    def encode(self, text: str) -> bytes:
        # bytes: only A-Z and ASCII blanks count here; the tokenizer itself lower-cases the rest
        raw = text.encode("utf-8", "replace").lower()
        if any(mark in raw for mark in self.special):  # also in other case, which the tokenizer takes for plain text
            return self.whole(text)
        return b"".join(map(self.__getitem__, raw.split()))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, text: str) -> bytes:
        tokens = self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.alphabet))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        found = self.LETTERS.fullmatch(text)
        if found is None:
            code = self.whole(text)
        elif found[2]:
            code = self[found[1].encode()] + self[found[2].encode()]
        else:
            code = self.letters(text)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = code
        return code


class SumOfSquares:
    """Open windows by fill level; ``counts`` is the level array."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def place(self, size: int, piece) -> list | None:
        """Put a piece of ``size`` < window into a window; the window's pieces if that fills it.

        From level h to h + size the sum of squares changes by 2 (n[h + size] - n[h]) + 2; a new window changes it by
        2 n[size] + 1, a filled one by 1 - 2 n[h].  Ties take the fullest window.
        """
        n, top = self.counts, self.window - size
        change = 2 * (n[size : self.window + 1] - n[: top + 1]) + 2  # by h = 0 … top
        change[0] = 2 * n[size] + 1
        change[top] = 1 - 2 * n[top]
        allowed = n[: top + 1] > 0
        allowed[0] = True
        level = top - int(np.argmin(np.where(allowed, change, np.iinfo(np.int64).max)[::-1]))
        if level:
            pieces = self.open[level].pop()
            n[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open[level + size].append(pieces)
        n[level + size] += 1
        return None

    def leftovers(self) -> Iterator:
        """Pieces of the windows still open, fullest first."""
        for windows in reversed(self.open):
            for pieces in windows:
                yield from pieces


def pack(documents: Iterable[tuple[object, bytes]], window: int, first_id: int) -> Iterator[tuple]:
    """Rows of RESULT for (doc_id, ids as bytes), end ids included; sequences are numbered from ``first_id``."""
    levels = SumOfSquares(window)
    number = first_id

    def rows(pieces: list) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            out.append((doc_id, start, length, zlib.crc32(ids), total, number, offset))
            offset += length
        return out

    for doc_id, ids in documents:
        total = len(ids) // 4
        for start in range(0, total, window):
            piece = (doc_id, start, ids[4 * start : 4 * (start + window)], total)
            size = len(piece[2]) // 4
            full = [piece] if size == window else levels.place(size, piece)
            if full:
                yield from rows(full)
                number += 1
    current, filled = [], 0
    for doc_id, start, ids, total in levels.leftovers():
        while ids:
            head, ids = ids[: 4 * (window - filled)], ids[4 * (window - filled) :]
            current.append((doc_id, start, head, total))
            start += len(head) // 4
            filled += len(head) // 4
            if filled == window:
                yield from rows(current)
                number, current, filled = number + 1, [], 0
    if current:
        yield from rows(current)


def _batches(rows: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RESULT.split(", ")]
    held = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence (columns of ``RESULT``).

    ``tokenizer`` is a file that every worker can read.  A null text is empty: its document is the end id alone.
    Repeated rows, and rows with a null id, are documents of their own.  A sequence shorter than ``window`` stands at
    the end of a task's input; it is padded unless its length is a power of two.  An empty table gives no rows.
    Sequence numbers are unique, not consecutive: the task's number times 2**33, then counted.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(tokenizer).encode

        def documents():
            for batch in batches:
                for at in range(batch.num_rows):
                    yield batch.column(0)[at].as_py(), encode(batch.column(1)[at].as_py()) + end

        yield from _batches(pack(documents(), window, TaskContext.get().partitionId() << 33))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, RESULT)
