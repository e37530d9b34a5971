"""Approximate nearest neighbours by multi-index hashing (Norouzi, Punjani & Fleet).

Vectors become binary codes: signs after rotations that iterative quantization (Gong & Lazebnik) learns from a bounded
sample.  A code is split into substrings of 16 bits, each with an index of its own: rows sorted by substring, and where
each value's rows start.  A query looks up, in every index, all values that differ in at most ``depth`` bits from its own
substring; by the pigeonhole principle this retrieves every code within a Hamming radius of substrings * (depth + 1) - 1,
and most codes far beyond it.  Retrieved codes within ``radius`` are ranked by their exact inner product.  No step
passes over all rows; ``touched`` counts the rows that a query retrieved.

Depth and radius are learned from the sample so that they hold nearly all true neighbours there, taken at the rank that
the k-th neighbour of the whole table has in the sample.  A query that finds fewer than ``k`` searches again with the
depth that holds every code.  Queries are broadcast in blocks of bounded bytes and meet the rows where those lie; a task
indexes its rows, and gives each query's best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgelens.session import StoredTables

K = 20
LEAST_BITS = 448  # of a code; short vectors take several rotations
SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 256
HELD_BY_DEPTH = 0.95  # share of the sample's true neighbours that the depth holds
HELD_BY_RADIUS = 0.985
INDEX_ROWS = 16_384  # rows that are indexed together; fewer where vectors are long
INDEX_BYTES = 64 << 20
QUERY_BYTES = 16 << 20  # of queries that are broadcast together
QUERIES_AT_ONCE = 64
SUBSTRING = 16
RESULT = "query_id long, vec_id long, score double, touched long"


@dataclass(frozen=True)
class Coder:
    """Rotations (dimensions x bits each), the norm that inner products are lifted with, learned radius and depth."""

    rotations: np.ndarray
    lift: float  # 0: all norms are equal
    radius: int
    depth: int

    def exhaustive(self) -> Coder:
        return Coder(self.rotations, self.lift, self.bits, SUBSTRING)

    @property
    def bits(self) -> int:
        return self.rotations.shape[0] * self.rotations.shape[2]

    def codes(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Substrings of 16 bits.  Where norms differ, a row gets one more coordinate that makes all norms equal, and a
        query a 0 there; the largest inner product is then the smallest angle."""
        return pack(np.concatenate([lifted(vectors, self.lift, query) @ r for r in self.rotations], axis=1) > 0)


def lifted(vectors: np.ndarray, lift: float, query: bool) -> np.ndarray:
    if not lift:
        return vectors
    missing = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(lift**2 - (vectors**2).sum(axis=1), 0.0))
    return np.column_stack([vectors, missing])


def pack(bits: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(bits), -(-bits.shape[1] // 16) * 16), dtype=bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint16)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def quantize(vectors: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """The rotation that brings unit vectors closest to the corners of a cube."""
    d = vectors.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds):
        corners = np.where(vectors @ rotation > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(corners.T @ vectors)
        rotation = (u @ v).T
    return rotation


def learn_coder(sample: np.ndarray, lift: float, n: int, k: int = K, rotations: int | None = None) -> Coder:
    """``n``: rows of the whole table, of which ``sample`` is a random part."""
    rows = lifted(sample, lift, False)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    count = rotations or -(-LEAST_BITS // rows.shape[1])
    coder = Coder(np.stack([quantize(unit, seed) for seed in range(count)]), lift, 0, 0).exhaustive()
    rank = max(1, round(k * len(sample) / n))
    asked = sample[:SAMPLE_QUERIES]
    codes, query_codes, far, parts = coder.codes(sample), coder.codes(asked, query=True), [], []
    for at in range(len(asked)):
        near = sample @ asked[at]
        near[at] = -np.inf
        best = np.argsort(-near)[: min(rank, len(sample) - 1)]
        bits = np.bitwise_count(codes[best] ^ query_codes[at])
        far.append(bits.sum(axis=1, dtype=np.int64))
        parts.append(bits.min(axis=1))
    if len(sample) < 20 * k:
        return coder
    hold = lambda found, share: int(np.ceil(np.quantile(np.concatenate(found), share)))
    return Coder(coder.rotations, lift, hold(far, HELD_BY_RADIUS), hold(parts, HELD_BY_DEPTH))


@cache
def flips(depth: int) -> np.ndarray:
    """All 16-bit masks of at most ``depth`` bits."""
    masks = np.arange(1 << SUBSTRING, dtype=np.uint16)
    return masks[np.bitwise_count(masks) <= depth]


class Index:
    """Some rows with an index per substring: row numbers sorted by its value, and where each value starts."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder):
        self.ids, self.vectors, self.codes = ids, vectors, coder.codes(vectors)
        self.sorted, self.starts = [], []
        for column in self.codes.T:
            order = np.argsort(column, kind="stable")
            self.sorted.append(order)
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(column, minlength=1 << SUBSTRING))]))

    def retrieved(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """Query x row: whether one of the row's substrings is within ``depth`` bits of the query's; by look-up only."""
        n, masks = len(self.ids), flips(depth)
        seen = np.zeros(len(codes) * n, dtype=bool)
        first_of = np.arange(len(codes))[:, None] * n
        for part, order, starts in zip(codes.T, self.sorted, self.starts):
            values = (part[:, None] ^ masks).astype(np.int64)
            begin, size = starts[values], starts[values + 1] - starts[values]
            some = np.nonzero(size)
            sizes, begins, bases = size[some], begin[some], np.broadcast_to(first_of, size.shape)[some]
            ends = np.cumsum(sizes)
            if len(ends):
                places = np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)
                seen[np.repeat(bases, sizes) + order[places]] = True
        return seen.reshape(len(codes), n)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, codes: np.ndarray, coder: Coder, k: int) -> Iterator[tuple]:
        """Per query its id, ids and scores of the best rows found, and how many rows were retrieved."""
        for begin in range(0, len(queries), QUERIES_AT_ONCE):
            part = slice(begin, begin + QUERIES_AT_ONCE)
            seen = self.retrieved(codes[part], coder.depth)
            for query_id, query, code, mine in zip(query_ids[part], queries[part], codes[part], seen):
                rows = np.flatnonzero(mine)
                touched = len(rows)
                rows = rows[(distances(self.codes[rows], code) <= coder.radius) & (self.ids[rows] != query_id)]
                points = self.vectors[rows] @ query
                if len(rows) > k:
                    least = np.partition(points, len(points) - k)[len(points) - k]
                    rows, points = rows[points >= least], points[points >= least]
                order = np.lexsort((self.ids[rows], -points))[:k]
                yield query_id, self.ids[rows][order], points[order], touched


def valid_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with an id and a vector that is not null, not zero and has finite components only; repeated rows once."""
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    return rows.where(
        F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0)
    ).dropDuplicates(["vec_id", "vec"])


def search(
    vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", rotations: int | None = None
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``, ``touched``: the ``k`` largest inner products found for
    every query, and the number of rows that it retrieved.

    ``is_query`` chooses the queries by ``vec_id``.  A row is never its own neighbour, nor is another vector under its
    id; of several vectors under a query's id the smallest one asks.  A candidate id with several vectors may be listed
    once for each of them.  Vectors take no part if they or their id are null, if they are zero or hold a component that
    is null or not finite, or if they have another length than most.  Equal scores go by ``vec_id``; fewer than ``k``
    candidates are all returned; an empty table gives no rows.  Further columns are ignored.
    """
    spark = vectors.sparkSession
    store = StoredTables(spark, "neighbours")
    rows = store.put(valid_vectors(vectors, key, vector), "valid")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x))
    common = (
        rows.groupBy(F.size("vec").alias("length"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(norm).alias("low"), F.max(norm).alias("high"))
        .orderBy(F.desc("n"), "length")
        .first()
    )
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, touched long")
    n, length = common["n"], common["length"]
    rows = rows.where(F.size("vec") == length)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE_ROWS).collect()
    lift = 0.0 if common["high"] - common["low"] < 1e-4 * common["high"] else common["high"]
    coder = learn_coder(np.array([r["vec"] for r in sample], dtype=np.float64), lift, n, k, rotations)
    size = max(1, min(INDEX_ROWS, INDEX_BYTES // (8 * length)))
    dealt = store.put(rows.repartition(-(-n // size), "vec_id", "vec"), "dealt")
    store.drop("valid")
    queries = store.put(dealt.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")), "queries")
    found = _best(store, "found", dealt, queries, coder, size, k)
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1))
    short = store.put(queries.join(enough, "query_id", "left_anti"), "short")
    if not short.isEmpty():
        again = _best(store, "again", dealt, short, coder.exhaustive(), size, k)
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(again)
    everything = W.partitionBy("query_id")
    touched = F.sum(F.when(F.col("first"), F.col("touched"))).over(everything)
    order = F.row_number().over(everything.orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumns({"touched": touched, "rank": order}).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "touched")


def _blocks(queries: DataFrame, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries in blocks of bounded bytes, fetched one partition at a time."""
    ids, points = [], []
    for row in queries.toLocalIterator():
        ids.append(row["query_id"])
        points.append(row["vec"])
        if len(ids) * length * 8 >= QUERY_BYTES:
            yield np.array(ids, np.int64), np.array(points, np.float64)
            ids, points = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(points, np.float64)


def _best(store: StoredTables, label: str, rows: DataFrame, queries: DataFrame, coder: Coder, size: int, k: int) -> DataFrame:
    """The ``k`` best rows of every query in every task; ``first`` marks one row per query and index, which has ``touched``."""
    spark, schema = rows.sparkSession, f"{RESULT}, first boolean"
    blocks = 0
    for ids, points in _blocks(queries, coder.rotations.shape[1]):
        shared = spark.sparkContext.broadcast((ids, points, coder.codes(points, query=True), coder))
        store.put(rows.mapInArrow(_searcher(shared, size, k), schema), f"{label}/block={blocks}")
        blocks += 1
    if not blocks:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, block int").parquet(f"{store.folder}/{label}").drop("block")


def _searcher(shared, size: int, k: int):
    def search_index(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        query_ids, points, codes, coder = shared.value
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = table.column("vec").chunk(0).flatten().to_numpy().reshape(table.num_rows, -1)
        index = Index(table.column("vec_id").to_numpy(), vectors, coder)
        out = [part for part in index.best(query_ids, points, codes, coder, k) if len(part[1])]
        sizes = np.array([len(near) for _, near, _, _ in out], dtype=np.int64)
        joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        first = np.zeros(int(sizes.sum()), dtype=bool)
        first[np.cumsum(sizes) - sizes] = True
        columns = [
            np.repeat(np.array([q for q, _, _, _ in out], np.int64), sizes),
            joined([near for _, near, _, _ in out], np.int64),
            joined([score for _, _, score, _ in out], np.float64),
            np.repeat(np.array([t for _, _, _, t in out], np.int64), sizes),
            first,
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score", "touched", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= size:
                yield search_index(held)
                held, n = [], 0
        if held:
            yield search_index(held)

    return run
