"""Hard-negative mining by rotated one-bit codes with stored code-vector alignments.

Every integer vector is rotated and written as a sum of sign vectors: the first code is the signs of the rotated vector,
each further one the signs of what is left.  The alignment of a code with the vector it codes, and the length of what
is left, are stored beside it.  Popcounts of the codes with the bit planes of an anchor estimate the inner product, and
by Cauchy-Schwarz the remainders bound its error, so that every row has an interval that holds its true product.
Rows whose interval cannot reach the anchor's list are left out code by code; the others are scored in integers.

The anchors are a stated query set: blocks of them, bounded in bytes, are broadcast and meet all rows where those lie, so
no row of the table is shuffled and no pair is written but each task's best.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.session import StoredTables

CODES = 5  # one-bit codes of a vector; each leaves about 0.6 of the length before it
PLANES = 8  # bit planes of a rotated anchor
SEED = 7
BLOCK_BYTES = 16 << 20  # of anchors that are broadcast together
FIRST_SLICE = 256  # rows that meet an anchor first; slices grow, so later ones meet a good threshold
SLACK = 1e-9  # relative error allowed for floating-point sums
POSITIVES = NEGATIVES = 5
SAFE = 2**62
NOTHING = -(2**63)

CODED = "vec_id long, label long, vector array<long>, codes binary, parts array<double>"
FOUND = "anchor long, list int, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@cache
def rotation(dim: int, code: int) -> np.ndarray:
    random = np.random.default_rng([SEED, dim, code]).normal(size=(dim, dim))
    return np.linalg.qr(random)[0] if dim else random


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, dim = bits.shape
    wide = np.zeros((n, max(1, -(-dim // 64)) * 8), np.uint8)
    wide[:, : -(-dim // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return wide.view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (code x word x row) and parts (three x code x row): alignments, lengths left after each code, and coded.

    A code's rotation is its own: signs of what is left in the same axes would align worse from code to code.
    """
    whole, root = vectors.astype(float), max(vectors.shape[1], 1) ** 0.5
    left, codes, parts = whole, [], []
    for code in range(CODES):
        axes = rotation(vectors.shape[1], code)
        turned = left @ axes
        positive = turned >= 0
        sign = np.where(positive, 1.0, -1.0) / root
        aligned = (turned * sign).sum(1)
        left = (turned - aligned[:, None] * sign) @ axes.T
        codes.append(_packed(positive).T)
        parts.append((aligned, np.linalg.norm(left, axis=1), np.linalg.norm(whole - left, axis=1)))
    return np.stack(codes), np.array(parts).transpose(1, 0, 2)


@dataclass
class Planes:
    """An anchor in one code's axes as ``low + step * sum(2^j plane_j)``, and the length of its error there."""

    words: np.ndarray
    counts: np.ndarray
    low: float
    step: float
    error: float
    dim: int

    @classmethod
    def of(cls, vector: np.ndarray, code: int) -> Planes:
        turned = vector.astype(float) @ rotation(len(vector), code)
        low, high = (turned.min(), turned.max()) if len(turned) else (0.0, 0.0)
        step = (high - low) / (2**PLANES - 1) or 1.0
        levels = np.rint((turned - low) / step).astype(np.int64)
        words = _packed((levels >> np.arange(PLANES)[:, None] & 1).astype(bool))
        error = float(np.linalg.norm(turned - low - step * levels))
        return cls(words, np.bitwise_count(words).sum(1, dtype=np.int64), low, step, error, len(vector))

    def products(self, codes: np.ndarray) -> np.ndarray:
        """Inner products of sign vectors (words x rows) with the approximated anchor, by popcounts."""
        ones, common = np.zeros(codes.shape[1], np.int32), np.zeros(codes.shape[1], np.int32)
        for word in codes:
            ones += np.bitwise_count(word)
        for plane in self.words[::-1]:  # Horner's rule over the planes, the highest first
            common <<= 1
            for w, word in enumerate(codes):
                common += np.bitwise_count(word & plane[w])
        weight = float((self.counts << np.arange(PLANES)).sum())
        total = self.low * (2.0 * ones - self.dim) + self.step * (2.0 * common - weight)
        return total / max(self.dim, 1) ** 0.5


@dataclass
class Anchor:
    number: int
    vec_id: int
    label: int
    vector: np.ndarray
    positives: list[int]  # scores, best first; empty while positives are looked for

    def planes(self) -> list[Planes]:
        return [Planes.of(self.vector, code) for code in range(CODES)]


def candidates(planes: list[Planes], length: float, codes: np.ndarray, parts: np.ndarray, least: float, most: float) -> np.ndarray:
    """Positions of the rows whose interval meets ``least`` to ``most``, after each code those still in.

    The estimate after some codes is the product of what they coded with the anchor's approximation.  What is left lies
    in a ball: by Cauchy-Schwarz its product with the anchor is at most the product of their lengths; the
    approximation's error likewise, code by code.
    """
    live: np.ndarray | None = None
    estimate = unsure = 0.0
    for code, plane in enumerate(planes):
        words = codes[code] if live is None else codes[code][:, live]
        aligned, left, coded = parts[:, code] if live is None else parts[:, code, live]
        estimate = estimate + aligned * plane.products(words)
        unsure = unsure + np.abs(aligned) * plane.error
        half = left * length + unsure + SLACK * ((left + coded) * length + 1)
        stays = (estimate + half >= least) & (estimate - half <= most)
        where = np.flatnonzero(stays)
        live = where if live is None else live[where]
        estimate, unsure = estimate[where], unsure[where]
        if not len(live):
            break
    return live


def scores(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products, in Python's integers where 64 bits could overflow."""
    size = max((int(np.abs(a).max()) if a.size else 0) for a in (vectors, anchor))
    if size * size * max(len(anchor), 1) >= SAFE:
        return vectors.astype(object) @ anchor.astype(object)
    return vectors @ anchor


class Best:
    """The first rows by (score descending, id), each (score, id) once."""

    def __init__(self, size: int):
        self.size, self.rows = size, []

    @property
    def least(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.size else NOTHING

    def add(self, points: Iterable[int], ids: Iterable[int]) -> None:
        new = {(-int(p), int(i)) for p, i in zip(points, ids)}
        self.rows = sorted(new.union(self.rows))[: self.size]


# -- passes over the table -------------------------------------------------------------------------------------


def _matrix(column: pa.Array, dtype: type, rows: np.ndarray) -> np.ndarray:
    return np.array(column.take(pa.array(rows)).to_pylist(), dtype=dtype).reshape(len(rows), -1)


def _by_dimension(column: pa.Array) -> Iterator[np.ndarray]:
    sizes = np.array(column.value_lengths().to_pylist(), dtype=np.int64)
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _encoder(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        for rows in _by_dimension(batch.column("vector")):
            part = batch.take(pa.array(rows))
            codes, parts = encode(_matrix(part.column("vector"), np.int64, np.arange(len(rows))))
            by_row = np.ascontiguousarray(codes.transpose(2, 0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id"),
                    part.column("label"),
                    part.column("vector"),
                    pa.array([row.tobytes() for row in by_row], pa.binary()),
                    pa.array(list(parts.reshape(-1, len(rows)).T), pa.list_(pa.float64())),
                ],
                names=["vec_id", "label", "vector", "codes", "parts"],
            )


def _slices(n: int) -> Iterator[slice]:
    start, size = 0, FIRST_SLICE
    while start < n:
        yield slice(start, start + size)
        start, size = start + size, 4 * size


def _searcher(broadcast, positives: bool, size: int):
    """Best rows of every anchor of a block among a task's rows.

    ``list`` numbers an anchor's lists: 0 for positives; for negatives, the positive they lie below.
    """

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = [(a, a.planes(), float(np.linalg.norm(a.vector.astype(float)))) for a in broadcast.value]
        best: dict[tuple[int, int], Best] = {}
        for batch in batches:
            for rows in _by_dimension(batch.column("vector")):
                for part in _slices(len(rows)):
                    there = _Rows.of(batch.take(pa.array(rows[part])))
                    for anchor, planes, length in anchors:
                        if len(anchor.vector) == there.vectors.shape[1]:
                            _search_one(anchor, planes, length, there, best, positives, size)
        out = [(a, at, i, -p) for (a, at), found in best.items() for p, i in found.rows]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                names=["anchor", "list", "vec_id", "score"],
            )

    return search


@dataclass
class _Rows:
    """Rows of one vector length, sorted by label."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        labels, n = batch.column("label").to_numpy(), batch.num_rows
        order = np.argsort(labels, kind="stable")
        words = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint64).reshape(n, CODES, -1)[order]
        parts = _matrix(batch.column("parts"), float, order).T.reshape(3, CODES, n)
        vectors = _matrix(batch.column("vector"), np.int64, order)
        codes = np.ascontiguousarray(words.transpose(1, 2, 0))
        return cls(batch.column("vec_id").to_numpy()[order], labels[order], vectors, codes, np.ascontiguousarray(parts))


def _search_one(
    anchor: Anchor, planes: list[Planes], length: float, rows: _Rows, best: dict, positives: bool, size: int
) -> None:
    """Add to the anchor's lists what these rows have for them; a list's own last entry raises its threshold."""
    if positives:
        wanted = {0: (float("-inf"), float("inf"))}
    else:
        wanted = {at: (-(-80 * p // 100), p) for at, p in enumerate(anchor.positives) if p >= 0}
    if not wanted:
        return
    lists = [best.setdefault((anchor.number, at), Best(size)) for at in wanted]
    bounds = [(max(held.least, low), high) for held, (low, high) in zip(lists, wanted.values())]
    least, most = min(low for low, _ in bounds), max(high for _, high in bounds)
    first, last = np.searchsorted(rows.labels, anchor.label), np.searchsorted(rows.labels, anchor.label, "right")
    if positives:
        near = first + candidates(planes, length, rows.codes[:, :, first:last], rows.parts[:, :, first:last], least, most)
    else:
        near = candidates(planes, length, rows.codes, rows.parts, least, most)
        near = near[(near < first) | (near >= last)]
    near = near[rows.ids[near] != anchor.vec_id]
    if not len(near):
        return
    points = scores(rows.vectors[near], anchor.vector)
    for held, (low, high) in zip(lists, bounds):
        inside = np.flatnonzero((points >= low) & (points <= high))
        if len(inside):
            held.add(points[inside], rows.ids[near[inside]])


def _merged(found: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= size)


def _blocks(anchors: DataFrame, block_bytes: int) -> Iterator[list[Anchor]]:
    """The anchors in blocks of bounded bytes, fetched one partition at a time."""
    block, held = [], 0
    for number, row in enumerate(anchors.toLocalIterator()):
        vector = np.array(row["vector"], dtype=np.int64)
        block.append(Anchor(number, row["vec_id"], row["label"], vector, []))
        held += vector.nbytes + 400
        if held > block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Hard negatives of the rows that ``anchors`` marks, among all ``rows`` (``vec_id``, ``label``, integer ``vector``).

    An anchor's positives are its ``positives`` best other rows of its label; a positive's negatives are the
    ``negatives`` best rows of other labels that score 80 % to 100 % of it.  Scores are integer inner products; higher
    ones come first, ties by ``vec_id``.  The result is exact: an interval that could reach a list is always scored.

    Rows with a null id, label, vector or component take no part.  A row is known by its id and score, so repeated
    rows count once; rows of an anchor's own id are never its positives or negatives; anchors that repeat id, label and
    vector are one.  Vectors of other lengths than the anchor's are not compared with it.  Scores must fit into 64
    bits.  Other columns are ignored; an empty table, or one without anchors, gives no rows.
    """
    spark = rows.sparkSession
    store = StoredTables(spark, "hard-negatives")
    usable = rows.where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)"
    ).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<bigint>"))
    coded = store.put(usable.mapInArrow(_encoder, CODED), "coded")
    asked = coded.where(anchors).select("vec_id", "label", "vector").distinct()
    stored = 0
    for number, block in enumerate(_blocks(asked, block_bytes)):
        shared = spark.sparkContext.broadcast(block)
        found = _merged(coded.mapInArrow(_searcher(shared, True, positives), FOUND), positives)
        by_anchor = {a.number: a for a in block}
        pairs = []
        for row in sorted(found.collect(), key=lambda r: (r["anchor"], r["rank"])):  # a few per anchor of the block
            anchor = by_anchor[row["anchor"]]
            pairs.append((anchor.number, len(anchor.positives), anchor.vec_id, row["vec_id"], row["score"]))
            anchor.positives.append(row["score"])
        shared.unpersist()
        shared = spark.sparkContext.broadcast(block)
        below = _merged(coded.mapInArrow(_searcher(shared, False, negatives), FOUND), negatives)
        named = spark.createDataFrame(
            pairs, "anchor long, list int, anchor_id long, positive_id long, positive_score long"
        )
        joined = below.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(named, ["anchor", "list"])
        columns = [name.split()[0] for name in RESULT.split(", ")]
        store.put(joined.select(*columns), f"found/block={number}")
        stored += 1
    if not stored:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(f"{RESULT}, block int").parquet(f"{store.folder}/found").drop("block")
