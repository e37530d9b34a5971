"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its word shingles, sketched by minwise tokens (the smallest hash of the set under each of
``SKETCH`` functions).  In each of ``TREES`` independent trees, a node picks on average 1/threshold of the minwise
positions at random and sends every document on to the child that its token at a picked position names, so that two
documents at the threshold meet in one child per level on average (Christiani, Pagh & Sivertsen, "Scalable and robust
set similarity join").  Nodes with at most ``LEAF`` documents are compared exhaustively, first by sketches, then on the
full sets; larger ones branch on.  Sketches are short, so a node of thousands still fits a task.

Links are what groups need, so all pairs of a group are never written: a compared node gives a spanning forest of its
links.  From the second level on, large nodes are also compared with one of their documents in a distributed join, and
a node whose documents are all linked with each other already is finished.  Nodes that are still large after
``MAX_DEPTH`` levels are compared exhaustively too, block by block, so that nothing is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.llm.common import grows, text_of
from lodgelens.session import StoredTables

SHINGLE = 5
SIMILARITY = (85, 100)
SKETCH = 64
TREES = 8
LEAF = 4096
LIST_BYTES = 64 << 20  # of full sets that a task compares at a time; longer lists go by pairs of blocks
MAX_DEPTH = 20
SLACK = 4.0  # standard deviations of a sketch's estimate below the similarity that still count as candidates
SIGNATURE = "doc_id long, n_shingles long, digest binary, sketch array<int>"


class Shingler(dict):
    """Word hashes by word (a bounded cache), and the shingle sets and sketches of texts."""

    LIMIT = 300_000
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, words: int, functions: int):
        super().__init__()
        self.words = words
        random = np.random.Generator(np.random.PCG64(11))
        self.factors = random.integers(0, 2**63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = random.integers(0, 2**63, functions, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code

    @classmethod
    def mix(cls, code: np.ndarray) -> np.ndarray:
        code = (code ^ (code >> np.uint64(31))) * cls.FACTOR
        return code ^ (code >> np.uint64(29))

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles; of the whole sequence, if it is shorter than a shingle."""
        # on bytes, lower() and split() know A-Z and the ASCII blanks only
        found = text.encode("utf-8", "replace").lower().split()
        code = np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))
        if not len(code):
            return code
        length = min(len(code), self.words)
        last = len(code) - length + 1
        out = np.full(last, length, dtype=np.uint64)
        for at in range(length):
            out = self.mix(out * self.FACTOR + code[at : at + last])
        return np.unique(out)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 2048):
            part = shingles[None, at : at + 2048] * self.factors[:, None] + self.shifts[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def linked(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets of distinct values is at least ``similarity``."""
    part, whole = similarity
    if not len(a) or not len(b) or whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    merged = np.concatenate([a, b])
    merged.sort()
    both = int((merged[1:] == merged[:-1]).sum())
    return whole * both >= part * (len(a) + len(b) - both)


def spanning_links(n: int, linked_among) -> list[tuple[int, int]]:
    """A spanning forest of a graph on 0 … n-1, breadth first; ``linked_among(i, others)`` gives the rows of the array
    ``others`` that i is linked with, and is never asked about rows already reached."""
    left, links = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = linked_among(i, left)
            links += [(i, int(j)) for j in near]
            queue += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return links


def signatures(docs: DataFrame, shingle: int = SHINGLE, sketch: int = SKETCH) -> DataFrame:
    """``SIGNATURE`` per row; the digest stands for the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        tool = Shingler(shingle, sketch)
        for batch in batches:
            sizes, digests, rows = [], [], []
            for text in batch.column(1):
                found = tool.shingles(text.as_py())
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                rows.append(tool.sketch(found))
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32())
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * sketch)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(ends, flat)], ["doc_id", "n_shingles", "digest", "sketch"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, SIGNATURE)


def shingle_sets(docs: DataFrame, ids: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(rep, tokens): the full sets of the documents whose ids are in ``ids.rep``, as sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Shingler(shingle, 1)
        for batch in batches:
            tokens = [tool.shingles(text.as_py()).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], ["rep", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), text_of().alias("text"))
    return rows.join(ids, "rep", "left_semi").mapInArrow(run, "rep long, tokens binary")


def _children(node: Column, sketch: Column, functions: int, similarity: tuple[int, int]) -> Column:
    """The child nodes that a node sends a sketch to; 1/similarity picks on average."""

    def child(pick: int) -> Column:
        position = F.pmod(F.xxhash64(node, F.lit(pick)), F.lit(functions)).cast("int")
        return F.xxhash64(node, position, F.element_at(sketch, position + 1))

    more = round(1000 * (similarity[1] / similarity[0] - 1))
    second = F.pmod(F.xxhash64(node, F.lit("picks")), F.lit(1000)) < more
    return F.when(second, F.array(child(1), child(2))).otherwise(F.array(child(1)))


class PathJoin:
    """The state of one join: documents by distinct set, and stored tables."""

    def __init__(self, docs: DataFrame, shingle: int, similarity: tuple[int, int], trees: int, store: StoredTables):
        self.docs, self.shingle, self.similarity, self.trees, self.store = docs, shingle, similarity, trees, store
        self.signed = store.put(signatures(docs, shingle), "signatures")
        self.reps = store.put(
            self.signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
            .groupBy("digest")
            .agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size")),
            "reps",
        )
        self.number = 0

    def put(self, df: DataFrame, label: str) -> DataFrame:
        self.number += 1
        return grows(self.store.put(df, f"{label}-{self.number}"))

    def branch(self, rows: DataFrame) -> DataFrame:
        """(node, rep, sketch) → (node, rep, n) of the children with several documents, stored."""
        kids = rows.select(
            "rep", F.explode(_children(F.col("node"), F.col("sketch"), SKETCH, self.similarity)).alias("node")
        )
        counts = kids.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")
        )
        shared = self.put(counts.where("n > 1 AND low < high").select("node", "n"), "counts")
        return self.put(kids.join(shared, "node"), "nodes")

    def leaves(self, nodes: DataFrame) -> DataFrame:
        """The distinct document lists of small nodes."""
        lists = nodes.where(F.col("n") <= LEAF).groupBy("node").agg(F.array_sort(F.collect_set("rep")).alias("reps"))
        return lists.select("reps").distinct()

    def large(self, nodes: DataFrame) -> DataFrame:
        return nodes.where(F.col("n") > LEAF).select("node", "rep")

    def alike(self, lists: DataFrame) -> DataFrame:
        """The parts of document lists that sketches connect which may reach the similarity, and the bytes of their
        documents' full sets, stored."""
        share = self.similarity[0] / self.similarity[1]
        least = (share - SLACK * (share * (1 - share) / SKETCH) ** 0.5) * SKETCH

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, sizes, begin = [], [], 0
                rows = batch.column(0).flatten()
                reps, size = rows.field("rep").to_numpy(), rows.field("size").to_numpy()
                sketches = rows.field("sketch").flatten().to_numpy().reshape(-1, SKETCH)
                for length in batch.column(0).value_lengths().to_pylist():
                    ids, own, held = (x[begin : begin + length] for x in (reps, sketches, size))
                    begin += length
                    part = np.arange(length)
                    for i, j in spanning_links(
                        length, lambda i, others: others[(own[others] == own[i]).sum(axis=1) >= least]
                    ):
                        part[j] = part[i]  # breadth first: i has its part already
                    order = np.argsort(part, kind="stable")
                    for members in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                        if len(members) > 1:
                            several, first = np.unique(ids[members], return_index=True)
                            found.append(several.tolist())
                            sizes.append(8 * int(held[members][first].sum()))
                columns = [pa.array(found, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["reps", "bytes"])

        met = self.members(lists, self.reps.select("rep", "sketch", "size"))
        return self.put(met.mapInArrow(run, "reps array<long>, bytes long").where(F.size("reps") > 1).distinct(), "alike")

    def members(self, lists: DataFrame, table: DataFrame, long: bool = False) -> DataFrame:
        """Every list with its documents' columns of ``table`` (one column, an array of structs of at most LEAF documents).

        ``long`` lists are cut into blocks by the bytes of their documents' full sets, and every pair of blocks is a
        list of its own, so that no task gathers more than LIST_BYTES and two sets.
        """
        numbered = self.put(lists.select("reps").withColumn("list", F.monotonically_increasing_id()), "lists")
        rows = numbered.select("list", F.explode("reps").alias("rep"))
        keys = ["list"]
        if long:
            rows, keys = self.paired(rows), ["list", "one", "two"]
        found = rows.join(grows(table), "rep").groupBy(*keys)
        return found.agg(F.collect_list(F.struct(*table.columns)).alias("members")).select("members")

    def paired(self, rows: DataFrame) -> DataFrame:
        """(list, rep) once per pair of blocks ``one``, ``two`` that the document's block takes part in."""
        sized = rows.join(grows(self.reps.select("rep", (8 * F.col("size")).alias("bytes"))), "rep")
        whole = Window.partitionBy("list")
        before = F.sum("bytes").over(whole.orderBy("rep")) - F.col("bytes")
        blocked = sized.select("list", "rep", F.floor(before / (LIST_BYTES // 2)).alias("block"))
        told = blocked.withColumn("last", F.max("block").over(whole))
        others = told.select("list", "rep", "block", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
        # a block meets itself in any of its pairs
        used = others.where((F.col("block") != F.col("other")) | (F.col("last") == 0))
        return used.select("list", "rep", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))

    def verified(self, lists: DataFrame, sets: DataFrame) -> DataFrame:
        """A spanning forest of the links in every list, on full sets."""
        similarity = self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                links = []
                for members in batch.column(0):
                    rows = members.values
                    ids = rows.field("rep").to_numpy()
                    tokens = [np.frombuffer(t, np.uint64) for t in rows.field("tokens").to_pylist()]
                    links += [
                        (int(ids[i]), int(ids[j]))
                        for i, j in spanning_links(
                            len(ids),
                            lambda i, others: others[[linked(tokens[i], tokens[j], similarity) for j in others]],
                        )
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"]
                )

        compared = self.members(lists.where(F.col("bytes") <= LIST_BYTES), sets)
        long = lists.where(F.col("bytes") > LIST_BYTES)
        if not long.isEmpty():
            compared = compared.unionByName(self.members(long, sets, long=True))
        return compared.mapInArrow(run, "a long, b long").where("a <> b")

    def with_leader(self, rows: DataFrame, sets: DataFrame, depth: int) -> DataFrame:
        """Links of the documents of large nodes with one of them, on full sets."""
        similarity = self.similarity
        leader = F.min("rep") if depth == 2 else F.min_by("rep", F.xxhash64("rep", F.lit(depth)))
        leaders = self.put(rows.groupBy("node").agg(leader.alias("leader")), "leaders")
        pairs = rows.join(leaders, "node").where("rep <> leader").select("leader", "rep").distinct()
        sided = self.put(pairs, "pairs").join(sets, "rep")
        firsts = sets.select(F.col("rep").alias("leader"), F.col("tokens").alias("leading"))
        both = sided.join(firsts, "leader").select("leader", "rep", "leading", "tokens")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [
                    linked(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), similarity)
                    for a, b in zip(batch.column(2), batch.column(3))
                ]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return self.put(both.mapInArrow(run, "a long, b long"), "links")

    def links(self) -> DataFrame:
        """Links (a, b) that connect what the similarity connects."""
        start = self.reps.select("rep", "sketch", F.explode(F.array(*[F.lit(t).cast("long") for t in range(self.trees)])).alias("node"))
        sketches = self.reps.select("rep", "sketch")
        nodes = self.branch(start)
        found, rest = [self.alike(self.leaves(nodes))], self.large(nodes)
        if not rest.isEmpty():
            nodes = self.branch(rest.join(grows(sketches), "rep"))
            found.append(self.alike(self.leaves(nodes)))
            rest = self.large(nodes)
        ids = union(found).select(F.explode("reps").alias("rep")).unionByName(rest.select("rep")).distinct()
        sets = self.put(shingle_sets(self.docs, self.put(ids, "candidates"), self.shingle), "sets")
        links, depth = [], 2
        while not rest.isEmpty():
            links.append(self.with_leader(rest, sets, depth))
            rest = self.put(self.unconnected(rest, components(union(links), self.store)), "rest")
            if depth == MAX_DEPTH:
                found.append(self.blocks(rest))
                break
            nodes = self.branch(rest.join(grows(sketches), "rep"))
            found.append(self.alike(self.leaves(nodes)))
            rest, depth = self.large(nodes), depth + 1
        links.append(self.put(self.verified(self.put(union(found).distinct(), "found"), sets), "links"))
        return union(links).distinct()

    def unconnected(self, rows: DataFrame, parts: DataFrame) -> DataFrame:
        """Rows of the nodes whose documents are not yet in one component."""
        labelled = self.put(
            rows.join(grows(parts), F.col("rep") == F.col("vertex"), "left").select(
                "node", "rep", F.coalesce("component", "rep").alias("label")
            ),
            "labelled",
        )
        mixed = labelled.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        return labelled.join(self.put(mixed.where("low < high").select("node"), "mixed"), "node").select("node", "rep")

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Lists that hold every pair of a node's documents: the pairs of blocks of half a leaf."""
        half = LEAF // 2
        sized = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        blocked = rows.join(self.put(sized, "sized"), "node").select(
            "node", "rep", F.ceil(F.col("n") / (half / 2)).cast("long").alias("count")
        ).withColumn("block", F.pmod(F.xxhash64("rep"), "count"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))
        paired = blocked.select("node", "rep", "block", other.alias("other")).select(
            "node", "rep", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
        )
        sized = paired.join(grows(self.reps.select("rep", "size")), "rep")
        lists = sized.groupBy("node", "one", "two").agg(
            F.array_sort(F.collect_set("rep")).alias("reps"), (8 * F.sum("size")).alias("bytes")
        )
        return self.put(lists.where(F.size("reps") > 1).select("reps", "bytes").distinct(), "blocks")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def components(links: DataFrame, store: StoredTables) -> DataFrame:
    """(vertex, component): the smallest vertex that each linked vertex can reach, itself not listed.

    Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond") until the links
    are stars; a vertex with very many links arrives as one row per task in the minimum and is split in the join.
    """
    name = f"components-{uuid.uuid4().hex}"
    edges = store.put(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), f"{name}-0")
    state, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = store.put(
            both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m")), f"{name}-{step}-large"
        )
        larger = both.join(grows(least), "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        spread = store.put(larger.where("v <> u").distinct(), f"{name}-{step}-spread")
        least = store.put(spread.groupBy("v").agg(F.min("u").alias("m")), f"{name}-{step}-small")
        joined = spread.join(grows(least), "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(
            joined.select("v", F.col("m").alias("u"))
        )
        step += 1
        edges = store.put(small.where("v <> u").distinct(), f"{name}-{step}")
        was, state = state, edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if state == was:
            return edges.select(F.col("v").alias("vertex"), F.col("u").alias("component"))


def near_groups(
    docs: DataFrame,
    shingle: int = SHINGLE,
    similarity: tuple[int, int] = SIMILARITY,
    trees: int = TREES,
    store: StoredTables | None = None,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when the Jaccard similarity of their shingle sets is at least ``similarity`` (a fraction).
    Equal sets are linked by a digest of the whole set and enter the trees once.  A null or blank text has no shingle
    and is linked with nothing.  Rows that share an id are one document of the graph.  A null id takes no part but
    counts as a copy of an equal set: it is kept only if no document with an id has that set.  An empty table gives an
    empty result; further columns are ignored.
    """
    store = store or StoredTables(docs.sparkSession, "near-dedup")
    join = PathJoin(docs, shingle, similarity, trees, store)
    parts = components(join.links(), store)
    sets = store.put(
        join.reps.join(grows(parts), F.col("rep") == F.col("vertex"), "left").select(
            "digest", F.coalesce("component", "rep").alias("found")
        ),
        "groups",
    )
    component = F.coalesce("found", "doc_id")
    return join.signed.join(grows(sets), "digest", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, store: StoredTables | None = None, **settings) -> DataFrame:
    """``docs`` without the documents (by id) of which a near-duplicate with a smaller id stays; same columns."""
    store = store or StoredTables(docs.sparkSession, "near-dedup")
    marked = near_groups(docs, store=store, **settings)
    gone = store.put(marked.where(~F.col("kept")).select(F.col("doc_id").alias("gone id")).distinct(), "gone")
    return docs.join(grows(gone), F.col("doc_id").cast("long") == F.col("gone id"), "left_anti")
