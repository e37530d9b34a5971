"""Language-model scores by a hierarchical Pitman-Yor process.

A token is drawn from the restaurant of its context, the previous word or the start of the text; all context
restaurants share one parent, the restaurant of single words, whose base measure is uniform over the training
vocabulary and one unknown word.  Every previous word has a restaurant of its own.  A token's probability is the mean of
the predictive probabilities of several sweeps over the seating.

Given the numbers of tables per restaurant, the seating of one word's customers does not depend on other words'.  So
the corpus is dealt out by word: a task holds all of its words' customers in every restaurant, sweeps over them, and
scores the words' occurrences.  The numbers of tables are summed over all tasks between two rounds of sweeps.

A sweep is a Gibbs sweep.  The number of tables of a cell (a word's customers in one restaurant) is drawn from its
conditional distribution, with weights S(customers, tables) * weight^tables, where S are the generalised Stirling
numbers and the weight is that of a new table.  In cells too large for a table of those numbers, customers are removed
and seated again one at a time: at a table with a chance as its size less the discount, at a new one as the weight.

The ``FREQUENT`` commonest words take up most tokens.  Where one follows another, occurrences are never shuffled: their
counts per pair are summed in the tasks that read the documents, and their probabilities (at most (CONTEXTS + 1) *
FREQUENT numbers, a fixed bound) are broadcast.  A pair of a frequent word behind a rare one is dealt out by the rare
one, any other pair by its word, so that no task gets a hot key.  Totals of the frequent words and contexts are short
arrays that the driver sums up; those of a rare context are summed by the task that owns it, which tells them to the
blocks with customers in it (``exchange``).
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.common import grows, text_of
from lodgelens.session import StoredTables

FREQUENT = 4096
CONTEXTS = FREQUENT  # 1 … FREQUENT - 1: the frequent words, FREQUENT: the start of a text, below 0: any other word
START = CONTEXTS
END = 0  # the code of the token that ends a text
STRENGTH = 1.0
ROUNDS = 2
BURN_IN = 2
SAMPLES = 4
TASK_TOKENS = 1_500_000
DRAWN_CUSTOMERS = 256  # cells up to this size are drawn at once, in larger ones customers move one at a time
MOVES = 8  # of a large cell's customers per sweep
COUNTED_WORDS = 400_000
HELD_TOKENS = 1_500_000
BUCKETS = 4  # per task
PAIR_BUCKETS = 1024  # of frequent words, so at most FREQUENT
SLICES = 64  # of an array of totals
DIGITS = 1e7  # sums of logarithms travel as multiples of 1 / DIGITS

TOKENS = (
    "rid long, doc_id long, train boolean, n_tokens long, frequent binary, "
    "bucket long, pairs binary"
)
BLOCK = (
    "words binary, counts binary, sizes binary, contexts binary, customers binary, seen binary, places binary, "
    "totals array<double>, block long"
)
TELLING, TOLD = "owner long, block long, totals binary", "block long, owner long, totals binary"
PAIRS, SUMS = "bucket long, pairs binary", "owner long, sums binary"
# totals of a block: customers per frequent context, tables per frequent context, then root customers, root tables,
# rare words, tokens, cells with one and two customers, rare words with one and two customers, and per frequent word
# its customers, those at the root, and tables at the root
N_TOTALS = 2 * (CONTEXTS + 1) + 8 + 3 * FREQUENT
TYPES = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def _rows(schema: str, columns: list) -> pa.RecordBatch:
    """A batch of ``schema``; None stands for a column of nulls."""
    names, types = zip(*[part.split() for part in schema.split(", ")])
    n = next(len(c) for c in columns if c is not None)
    arrays = [pa.nulls(n, TYPES[t]) if c is None else pa.array(c, TYPES[t]) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers by planes of bytes, compressed."""
    sizes = np.array([len(arrays), *map(len, arrays)], np.int64)
    held = np.concatenate([np.asarray(x).astype(np.int64, copy=False) for x in arrays])
    planes = np.ascontiguousarray(held.view(np.uint8).reshape(-1, 8).T).tobytes()
    return sizes.tobytes() + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked(held: bytes) -> list[np.ndarray]:
    sizes = np.frombuffer(held, np.int64, np.frombuffer(held, np.int64, 1)[0], 8)
    n, head = int(sizes.sum()), 8 + 8 * len(sizes)
    planes = pa.decompress(held[head:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
    numbers = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).reshape(-1).view(np.int64)
    return np.split(numbers, np.cumsum(sizes)[:-1])


def _coded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and which one stands where."""
    return np.unique(codes, return_inverse=True)


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (codes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted keys."""
    fresh = np.ones(len(keys[0]), dtype=bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(fresh)


class WordCodes(dict):
    """Frequent words → their code; other words → a negative 63-bit hash (bounded cache)."""

    LIMIT = 250_000

    def __init__(self, frequent: list[bytes]):
        super().__init__(zip(frequent, range(1, len(frequent) + 1)))
        self.frequent = dict(self)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
            self.update(self.frequent)
        self[word] = code = -1 - (xxhash.xxh3_64_intdigest(word) >> 1)
        return code


def words_of(text: str) -> list[bytes]:
    """On bytes, lower() and split() know A-Z and the ASCII blanks only."""
    return text.encode("utf-8", "replace").lower().split()


def commonest_words(rows: DataFrame, n: int = FREQUENT - 1) -> tuple[list[bytes], int]:
    """The words to treat as frequent, from the training rows, and the number of words of all rows.

    A task's counter is thinned out from below when it is full, so counts of rare words may be too low here; this choice
    decides by which way a word is counted, exactly, later on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, least, total = Counter(), 1, 0
        for batch in batches:
            for train, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                total += len(words)
                if not train.as_py():
                    continue
                counter.update(words)
                while len(counter) > COUNTED_WORDS:
                    counter = Counter({w: c for w, c in counter.items() if c > least})
                    least += 1
        top = counter.most_common(8 * n)
        yield _rows("word binary, n long", [[w for w, _ in top] + [None], [c for _, c in top] + [total]])

    counted = rows.select("train", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit(n + 1).collect()
    words = [bytes(row["word"]) for row in found if row["word"] is not None]
    return words[:n], sum(row["n"] for row in found if row["word"] is None)


def tokenize(docs: DataFrame, frequent: list[bytes], buckets: int) -> DataFrame:
    """``TOKENS``, two kinds of rows.  Per document a number ``rid``, and its pairs of frequent words as context *
    FREQUENT + code.  Per bucket all other occurrences of some documents, sorted: words, how often each is there, their
    contexts, and their places, that is rid and whether the document trains, in one number."""

    def dealt(held: list) -> pa.RecordBatch:
        word, context, place = (np.concatenate(x) for x in zip(*held))
        bucket = _bucket(np.where(word < 0, word, context), buckets)
        order = np.lexsort((context, word, bucket))
        word, context, place, bucket = word[order], context[order], place[order], bucket[order]
        starts = _starts(bucket)
        rows = []
        for begin, end in zip(starts, np.append(starts[1:], len(word))):
            words, sizes = np.unique(word[begin:end], return_counts=True)
            rows.append([bucket[begin], packed(words, sizes, *_coded(context[begin:end]), place[begin:end])])
        return _rows(TOKENS, [None] * 5 + list(zip(*rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, rid = WordCodes(frequent), TaskContext.get().partitionId() << 31
        held, n_held = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                rids, sizes, common = [], [], []
                for train, text in zip(part.column(1), part.column(2)):
                    words = words_of(text.as_py())
                    code = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
                    code = np.append(code, END)
                    context = np.append(START, code[:-1])
                    both = (code >= 0) & (context >= 0)
                    rids.append(rid)
                    sizes.append(len(code))
                    common.append((context[both] * FREQUENT + code[both]).astype(np.int32).tobytes())
                    rare = ~both
                    n = int(rare.sum())
                    if n:
                        held.append((code[rare], context[rare], np.full(n, (rid << 1) + int(train.as_py()))))
                        n_held += n
                    rid += 1
                yield _rows(TOKENS, [rids, part.column(0), part.column(1), sizes, common, None, None])
                if n_held >= HELD_TOKENS:
                    yield dealt(held)
                    held, n_held = [], 0
        if held:
            yield dealt(held)

    return docs.mapInArrow(run, TOKENS)


def frequent_cells(tokens: DataFrame) -> DataFrame:
    """``PAIRS``: the pairs of frequent words in the training rows and how often a task has read them, by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CONTEXTS + 1) * FREQUENT, dtype=np.uint32)  # a task reads fewer pairs than that can count
        for batch in batches:
            held = b"".join(cells.as_py() for cells in batch.column(0))
            cells, n = np.unique(np.frombuffer(held, np.int32), return_counts=True)
            total[cells] += n.astype(np.uint32)
        cells = np.flatnonzero(total).astype(np.int32)
        cells = cells[np.argsort((cells % PAIR_BUCKETS).astype(np.int16), kind="stable")]
        starts = _starts(cells % PAIR_BUCKETS)
        for begin, end in zip(starts, np.append(starts[1:], len(cells))):
            part = cells[begin:end]
            yield _rows(PAIRS, [[part[0] % PAIR_BUCKETS], [packed(np.diff(part, prepend=0), total[part])]])

    return tokens.where("NOT dealt AND train").select("frequent").mapInArrow(run, PAIRS)


def _block(
    word: np.ndarray, context: np.ndarray, n: np.ndarray, seen: np.ndarray, places: np.ndarray, block: int = 0
) -> pa.RecordBatch:
    """A block from sorted cells (word, context, customers); ``seen``: occurrences to score per cell, at ``places``.

    Pairs without customers are there with a cell of none."""
    words, first = np.unique(word, return_index=True)
    sizes = np.diff(np.append(first, len(word)))
    counts = np.add.reduceat(n, first) if len(word) else np.zeros(0, np.int64)
    used = np.add.reduceat((n > 0).astype(np.int64), first) if len(word) else counts
    totals = np.zeros(N_TOTALS)
    m, near, rare = CONTEXTS + 1, context >= 0, words < 0
    totals[:m] = np.bincount(context[near], weights=n[near], minlength=m)
    totals[m : 2 * m] = np.bincount(context[near], weights=n[near] > 0, minlength=m)
    known = (counts[rare] > 0).sum()
    totals[2 * m : 2 * m + 8] = [
        (n > 0).sum(), known, known, n.sum(),
        (n == 1).sum(), (n == 2).sum(), (counts[rare] == 1).sum(), (counts[rare] == 2).sum(),
    ]
    of_words = totals[2 * m + 8 :].reshape(3, FREQUENT)
    of_words[0, words[~rare]], of_words[1, words[~rare]] = counts[~rare], used[~rare]
    blobs = [[packed(*x)] for x in ([words], [counts], [sizes], _coded(context), [n], [seen], [places])]
    return _rows(BLOCK, [*blobs, [totals.tolist()], [block]])


def rare_blocks(tokens: DataFrame, parts: int) -> DataFrame:
    """Blocks of the pairs with a word that is not frequent; a pair, and a rare word, lies in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for pairs in batch.column(1):
                words, sizes, contexts, at, place = unpacked(pairs.as_py())
                held.append((np.repeat(words, sizes), contexts[at], place))
        if not held:
            return
        word, context, place = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, context, word))
        word, context, place = word[order], context[order], place[order]
        cells = _starts(word, context)
        n, seen = np.add.reduceat(place & 1, cells), np.diff(np.append(cells, len(word)))
        # from here on a rare word is known by its number in the block, below 0
        names, number = np.unique(word[cells], return_inverse=True)
        word = np.where(word[cells] < 0, number - (names < 0).sum(), word[cells])
        yield _block(word, context[cells], n, seen, place >> 1, TaskContext.get().partitionId())

    rows = tokens.where("dealt").select("bucket", "pairs")
    return rows.repartition(parts, "bucket").mapInArrow(run, BLOCK)


def frequent_blocks(cells: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpacked(pairs.as_py()) for batch in batches for pairs in batch.column(1)]
        if not held:
            return
        cell, at = np.unique(np.concatenate([np.cumsum(steps) for steps, _ in held]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)
        word, context = cell % FREQUENT, cell // FREQUENT
        order = np.lexsort((context, word))
        nothing = np.zeros(0, np.int64)
        yield _block(word[order], context[order], n[order], nothing, nothing)

    return cells.repartition(parts, "bucket").mapInArrow(run, BLOCK)


@functools.lru_cache(maxsize=4)
def stirling(discount: float, size: int = DRAWN_CUSTOMERS) -> np.ndarray:
    """log S(c, t) for c, t up to ``size``: the weight of all ways to seat c customers at t tables."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    tables = np.arange(size + 1)
    for c in range(size):
        with np.errstate(divide="ignore", invalid="ignore"):
            old = out[c] + np.log(np.maximum(c - discount * tables, 0.0))
        out[c + 1] = np.logaddexp(np.where(np.isnan(old), -np.inf, old), np.append(-np.inf, out[c, :-1]))
    return out


class Cells:
    """Numbers of tables of cells with at least two customers, and Gibbs sweeps over them."""

    AT_ONCE = 1 << 18  # numbers of a matrix of weights

    def __init__(self, customers: np.ndarray, random: np.random.Generator):
        self.customers, self.random = customers, random
        order = np.argsort(customers, kind="stable")
        small = order[: np.searchsorted(customers[order], DRAWN_CUSTOMERS, side="right")]
        self.groups = np.split(small, _starts(customers[small])[1:]) if len(small) else []
        self.large = order[len(small) :]
        self.moved: Seats | None = None

    def sweep(self, weight: np.ndarray, discount: float) -> np.ndarray:
        """Tables of every cell, given the weight of a new one in each."""
        tables = np.empty(len(self.customers))
        logs = stirling(round(discount, 6))
        for cells in self.groups:
            c = int(self.customers[cells[0]])
            ways, numbers = logs[c, 1 : c + 1], np.arange(1, c + 1)
            for begin in range(0, len(cells), max(1, self.AT_ONCE // c)):
                part = cells[begin : begin + max(1, self.AT_ONCE // c)]
                score = ways + np.log(weight[part])[:, None] * numbers
                score -= score.max(axis=1, keepdims=True)
                upto = np.exp(score, out=score).cumsum(axis=1, out=score)
                drawn = self.random.random(len(part)) * upto[:, -1]
                tables[part] = np.minimum((upto <= drawn[:, None]).sum(axis=1), c - 1) + 1
        if len(self.large):
            if self.moved is None:
                self.moved = Seats(self.customers[self.large], weight[self.large], discount, self.random)
            for _ in range(MOVES):
                self.moved.move(weight[self.large], discount)
            tables[self.large] = self.moved.tables
        return tables


class Seats:
    """Customers of large cells by table.  They start as if seated one after another (see ``first_tables``)."""

    def __init__(self, customers: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator):
        self.customers, self.random = customers.astype(np.int64), random
        self.tables = first_tables(self.customers, weight, discount, random)
        room = self.tables + MOVES * (BURN_IN + SAMPLES)
        self.used = np.cumsum(room) - room  # the next free place of each cell
        self.sizes = np.zeros(int(room.sum()), np.int64)
        for cell, (start, n) in enumerate(zip(self.used, self.tables)):
            share = random.dirichlet(np.full(n, 1.0 - discount)) if n > 1 else np.ones(1)
            self.sizes[start : start + n] = 1 + random.multinomial(self.customers[cell] - n, share)
        self.used += self.tables
        self.before = np.cumsum(self.customers) - self.customers

    def move(self, weight: np.ndarray, discount: float) -> None:
        """One customer of every cell, drawn at random, gets up and is seated again."""
        upto, n = np.cumsum(self.sizes), len(self.customers)
        who = (self.random.random(n) * self.customers).astype(np.int64)
        left = np.searchsorted(upto, self.before + who, side="right")
        self.sizes[left] -= 1
        gone = self.sizes[left] == 0
        self.tables -= gone
        alone = weight / (weight + (self.customers - 1) - discount * self.tables)
        new = self.random.random(n) < alone
        place = np.where(gone, left, self.used)
        self.used += new & ~gone
        rest = np.flatnonzero(~new)
        while len(rest):  # the table of another customer, drawn at random, is taken with a chance of 1 - discount / its size
            other = (self.random.random(len(rest)) * (self.customers[rest] - 1)).astype(np.int64)
            other += other >= who[rest]
            table = np.searchsorted(upto, self.before[rest] + other, side="right")
            taken = self.random.random(len(rest)) < 1.0 - discount / self.sizes[table]
            place[rest[taken]] = table[taken]
            rest = rest[~taken]
        self.sizes[place] += 1
        self.tables += new


def first_tables(customers: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Numbers of tables to start from: customers come in runs of a twentieth of those seated, one draw per run."""
    tables, seated = np.ones(len(customers)), 1
    while True:
        active = np.flatnonzero(customers > seated)
        if not len(active):
            return tables.astype(np.int64)
        run = max(1, seated // 20)
        new = weight[active] / (weight[active] + seated - discount * tables[active])
        tables[active] += random.binomial(np.minimum(customers[active] - seated, run), np.minimum(new, 1.0))
        seated += run


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of cells of any size, drawn given the weight of a new one."""
    tables = np.minimum(customers, 1).astype(np.float64)
    many = np.flatnonzero(customers > 1)
    if len(many):
        tables[many] = Cells(customers[many], random).sweep(weight[many], discount)
    return tables


class Restaurants:
    """Discounts and the totals of the frequent restaurants, from the sums over all blocks."""

    def __init__(self, totals: np.ndarray):
        m = CONTEXTS + 1
        self.customers, self.tables = totals[:m], totals[m : 2 * m]
        self.root_customers, self.root_tables, words, self.tokens = totals[2 * m : 2 * m + 4]
        ones, twos, word_ones, word_twos = totals[2 * m + 4 : 2 * m + 8]
        self.counts, self.at_root, tables = totals[2 * m + 8 :].reshape(3, FREQUENT)
        self.words = words + (self.counts > 0).sum()
        self.discount = self.estimate(ones, twos)
        self.root_discount = self.estimate(word_ones + (self.counts == 1).sum(), word_twos + (self.counts == 2).sum())
        self.base = 1.0 / (self.words + 1.0)
        self.root = self.root_probability(self.at_root, tables)

    @staticmethod
    def estimate(ones: float, twos: float) -> float:
        """The usual estimate of a discount from the numbers of cells with one and with two customers."""
        return min(max(ones / (ones + 2.0 * twos), 0.1), 0.95) if ones else 0.5

    def new_table(self) -> np.ndarray:
        return STRENGTH + self.discount * self.tables

    def new_root_table(self) -> float:
        return (STRENGTH + self.root_discount * self.root_tables) * self.base

    def root_probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        new = STRENGTH + self.root_discount * self.root_tables
        return (customers - self.root_discount * tables + new * self.base) / (STRENGTH + self.root_customers)


class Seating:
    """The customers of a block's words, and sweeps over them.  ``told`` has the totals of the block's rare contexts."""

    def __init__(self, block: dict, house: Restaurants, seed: int, told: list[dict] | None = None, owners: int = 1):
        get = {k: unpacked(block[k])[0] for k in ("words", "counts", "sizes", "customers", "seen", "places")}
        self.words, self.counts, self.sizes = get["words"], get["counts"], get["sizes"]
        contexts, at = unpacked(block["contexts"])
        self.context, self.customers = contexts[at], get["customers"]
        self.seen, self.places = get["seen"], get["places"]
        self.house = house
        self.word = np.repeat(np.arange(len(self.words)), self.sizes)
        self.random = np.random.default_rng([seed, block["block"], *(int(x) & (2**63 - 1) for x in (self.words[0], self.context[0]))])
        self.tables = np.minimum(self.customers, 1).astype(np.float64)
        self.root_tables = np.minimum(self.counts, 1).astype(np.float64)
        self.many = np.flatnonzero(self.customers > 1)
        self.cells = Cells(self.customers[self.many], self.random)
        self.own = np.flatnonzero(self.words < 0)  # all customers of a rare word are here, so it is seated at the root too
        far = self.context < 0
        self.rare, at = np.unique(self.context[far], return_inverse=True)
        m = CONTEXTS + 1
        self.slot = self.context.copy()
        self.slot[far] = m + at
        customers, tables = (np.append(x, np.zeros(len(self.rare))) for x in (house.customers, house.tables))
        owned = self.by_owner(owners) if told else {}
        for part in told or []:
            where = m + owned[part["owner"]]
            customers[where], tables[where] = unpacked(part["totals"])
            tables[where] /= SAMPLES
        self.in_context, self.new_table = customers, STRENGTH + house.discount * tables

    def by_context(self, values: np.ndarray) -> np.ndarray:
        """Sums over the cells, for the frequent contexts and then the block's rare ones."""
        return np.bincount(self.slot, weights=values, minlength=CONTEXTS + 1 + len(self.rare))

    def root(self) -> np.ndarray:
        """Root probabilities of the words; a frequent word's is that of the last synchronisation."""
        p = self.house.root_probability(self.root_customers(), self.root_tables)
        return np.where(self.words < 0, p, self.house.root[np.maximum(self.words, 0)])

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.word, weights=self.tables, minlength=len(self.words))

    def sweep(self) -> None:
        house, many = self.house, self.many
        weight = self.new_table[self.slot[many]] * self.root()[self.word[many]]
        self.tables[many] = self.cells.sweep(weight, house.discount)
        at_root = self.root_customers()[self.own].astype(np.int64)
        # the customers of the root change in every sweep, so its tables are drawn given those of the contexts
        weight = np.full(len(at_root), house.new_root_table())
        self.root_tables[self.own] = draw_tables(at_root, weight, house.root_discount, self.random)

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean totals of tables, tables per rare context summed over the samples, and mean probability per cell."""
        m = CONTEXTS + 1
        totals, rare, cell = np.zeros(m + 2 + FREQUENT), np.zeros(len(self.rare)), np.zeros(len(self.word))
        near = np.flatnonzero(self.words >= 0)
        for number in range(BURN_IN + SAMPLES):
            self.sweep()
            if number < BURN_IN:
                continue
            at_root, in_context = self.root_customers(), self.by_context(self.tables)
            totals[:m] += in_context[:m]
            rare += in_context[m:]
            totals[m : m + 2] += at_root.sum(), self.root_tables[self.own].sum()
            totals[m + 2 + self.words[near]] += at_root[near]
            own = np.where(self.customers > 0, self.customers - self.house.discount * self.tables, 0.0)
            cell += (own + self.new_table[self.slot] * self.root()[self.word]) / (STRENGTH + self.in_context[self.slot])
        return totals / SAMPLES, rare, cell / SAMPLES

    def by_owner(self, owners: int) -> dict[int, np.ndarray]:
        """Which of the block's rare contexts an owner has."""
        owner = _bucket(self.rare, owners)
        order = np.argsort(owner, kind="stable")
        starts = _starts(owner[order])
        return {int(owner[part[0]]): part for part in np.split(order, starts[1:]) if len(part)}

    def telling(self, rare_tables: np.ndarray, block: int, owners: int) -> pa.RecordBatch:
        """``TELLING``: this block's customers and tables (times SAMPLES) in its rare contexts, by their owner."""
        customers = self.by_context(self.customers)[CONTEXTS + 1 :]
        rows = [
            (owner, block, packed(self.rare[part], customers[part], rare_tables[part]))
            for owner, part in self.by_owner(owners).items()
        ]
        return _rows(TELLING, list(zip(*rows)) if rows else [[], [], []])


def _blocks_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for row in range(batch.num_rows):
        yield {name: batch.column(k)[row].as_py() for k, name in enumerate(batch.schema.names) if name != "totals"}


def exchange(tellings: DataFrame, parts: int) -> DataFrame:
    """From what blocks tell of their rare contexts, (block, told) with the totals of these contexts over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        by_owner = {}
        for row in rows:
            by_owner.setdefault(row["owner"], []).append((row["block"], unpacked(row["totals"])))
        for owner, tellings in by_owner.items():
            contexts, customers, tables = (np.concatenate(x) for x in zip(*[told for _, told in tellings]))
            _, at = np.unique(contexts, return_inverse=True)
            sums = [np.bincount(at, weights=x)[at] for x in (customers, tables)]
            ends = np.cumsum([len(told[0]) for _, told in tellings])[:-1]
            told = [packed(*x) for x in zip(*[np.split(s, ends) for s in sums])]
            yield _rows(TOLD, [[block for block, _ in tellings], [owner] * len(told), told])

    replies = tellings.repartition(parts, "owner").mapInArrow(run, TOLD)
    return replies.groupBy("block").agg(F.collect_list(F.struct("owner", "totals")).alias("told"))


def first_tellings(blocks: DataFrame, house: Restaurants, owners: int) -> DataFrame:
    """What blocks tell while every customer of a pair sits at one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks_of(batch):
                seating = Seating(block, house, 0)
                tables = SAMPLES * seating.by_context(seating.tables)[CONTEXTS + 1 :]
                yield seating.telling(tables, block["block"], owners)

    return _cells_of(blocks).mapInArrow(run, TELLING)


def _cells_of(blocks: DataFrame) -> DataFrame:
    """Blocks without occurrences to score."""
    nothing = F.lit(packed(np.zeros(0, np.int64)))
    return blocks.drop("totals").withColumn("seen", nothing).withColumn("places", nothing)


def _summed(lists: DataFrame) -> np.ndarray:
    """The elementwise sum of a column ``totals`` of equally long arrays, by slices."""
    schema = "slice long, sums binary"

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for totals in batch.column(0):
                total = total + totals.values.to_numpy()
        if np.ndim(total):
            parts = np.array_split(total, SLICES)
            yield _rows(schema, [list(range(SLICES)), [part.tobytes() for part in parts]])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[at] = sums.get(at, 0.0) + np.frombuffer(part.as_py())
        yield _rows(schema, [list(sums), [part.tobytes() for part in sums.values()]])

    parts = lists.select("totals").mapInArrow(sliced, schema).repartition(SLICES, "slice").mapInArrow(added, schema)
    found = {row["slice"]: np.frombuffer(row["sums"]) for row in parts.collect()}
    return np.concatenate([np.zeros(0), *(found[at] for at in sorted(found))])


def sample_tables(blocks: DataFrame, house: Restaurants, seed: int, owners: int) -> DataFrame:
    """A round of sweeps: rows with sums of tables, and ``TELLING`` rows."""
    schema = f"sums array<double>, {TELLING}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks_of(batch):
                seating = Seating(block, house, seed, block["told"], owners)
                totals, rare, _ = seating.run()
                yield _rows(schema, [[totals.tolist()], None, None, None])
                told = seating.telling(rare, block["block"], owners)
                yield _rows(schema, [None, *told.columns])

    return blocks.mapInArrow(run, schema)


def with_told(blocks: DataFrame, told: DataFrame) -> DataFrame:
    return blocks.join(grows(told), "block", "left")


def seat_frequent(totals: np.ndarray, seed: int) -> Restaurants:
    """Seats the frequent words' customers at the root, and adds their tables to the totals."""
    house, m = Restaurants(totals), CONTEXTS + 1
    tables = np.minimum(house.at_root, 1.0)
    totals[2 * m + 1] += tables.sum()
    new = np.full(FREQUENT, Restaurants(totals).new_root_table())
    drawn = draw_tables(np.rint(house.at_root).astype(np.int64), new, house.root_discount, np.random.default_rng(seed))
    totals[2 * m + 1] += drawn.sum() - tables.sum()
    totals[2 * m + 8 + 2 * FREQUENT :] = drawn
    return Restaurants(totals)


def frequent_probabilities(blocks: DataFrame, house: Restaurants, seed: int) -> np.ndarray:
    """log10 of probabilities by context * FREQUENT + code of the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks_of(batch):
                seating = Seating(block, house, seed)
                cell = seating.context * FREQUENT + seating.words[seating.word]
                p = np.log10(seating.run()[2])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(p, pa.float32())], ["cell", "p"])

    found = _cells_of(blocks).mapInArrow(run, "cell int, p float").toArrow()
    unseen = house.new_table() / (STRENGTH + house.customers)
    table = np.add.outer(np.log10(unseen).astype(np.float32), np.log10(house.root).astype(np.float32)).ravel()
    table[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return table


PARTS = "rid long, doc_id long, train boolean, n_tokens long, n_known long, base double, score double"


def rare_scores(blocks: DataFrame, house: Restaurants, seed: int, owners: int) -> DataFrame:
    """``PARTS`` of the pairs with a rare word: a block's sums by document go to the document's owner, who adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks_of(batch):
                seating = Seating(block, house, seed, block["told"], owners)
                score = np.log10(seating.run()[2])
                counts = np.where(seating.words < 0, seating.counts, house.counts[np.maximum(seating.words, 0)])
                at = np.repeat(np.arange(len(score)), seating.seen)
                word = seating.word[at]
                rid, place = np.unique(seating.places, return_inverse=True)
                known = np.bincount(place, weights=counts[word] > 0)
                sums = [np.rint(DIGITS * np.bincount(place, weights=x)) for x in (np.log10(counts + 1.0)[word], score[at])]
                owner = _bucket(rid * 0x9E3779B97F4A7C1, owners)
                order = np.argsort(owner, kind="stable")
                rows = [
                    (owner[part[0]], packed(np.diff(rid[part], prepend=0), *(x[part] for x in (known, *sums))))
                    for part in np.split(order, _starts(owner[order])[1:])
                ]
                yield _rows(SUMS, list(zip(*rows)))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpacked(sums.as_py()) for batch in batches for sums in batch.column(1)]
        if not held:
            return
        rids, *values = (np.concatenate(x) for x in zip(*[(np.cumsum(steps), *rest) for steps, *rest in held]))
        rid, at = np.unique(rids, return_inverse=True)
        known, base, score = (np.bincount(at, weights=x) for x in values)
        for begin in range(0, len(rid), 100_000):
            p = slice(begin, begin + 100_000)
            yield _rows(PARTS, [rid[p], None, None, None, known[p].astype(np.int64), base[p] / DIGITS, score[p] / DIGITS])

    return blocks.mapInArrow(run, SUMS).repartition(owners, "owner").mapInArrow(added, PARTS)


def frequent_scores(tokens: DataFrame, logs: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Sums per row over the pairs of frequent words; the tables have a fixed size."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast((logs, counts > 0, np.log10(counts + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p, known, log_count = shared.value
        for batch in batches:
            rows = []
            for cells in batch.column(4):
                cell = np.frombuffer(cells.as_py(), np.int32)
                code = cell % FREQUENT
                rows.append((int(known[code].sum()), float(log_count[code].sum()), float(log_p[cell].sum(dtype=np.float64))))
            known_n, base, score = zip(*rows) if rows else ((), (), ())
            yield _rows(PARTS, [*batch.columns[:4], known_n, base, score])

    return tokens.where("NOT dealt").select("rid", "doc_id", "train", "n_tokens", "frequent").mapInArrow(run, PARTS)


def score_documents(docs: DataFrame, train: Column, seed: int = 3) -> DataFrame:
    """Per row: ``doc_id``, ``trains``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``,
    ``perplexity``.

    Tokens are lower-cased words and one end.  ``train`` says which rows are learned from.  ``base_score`` is the sum of
    log10((c + 1) / (N + V + 1)) over the tokens, ``score`` the model's log10 probability of the text.  A null text is
    empty: it has the end token only.  Repeated rows are scored, and learned from, each.  Without training rows every
    token has probability 1/(V+1) = 1.  An empty table gives no rows; further columns are ignored.
    """
    store = StoredTables(docs.sparkSession, "language-model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), text_of().alias("text"))
    frequent, words = commonest_words(rows)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // TASK_TOKENS))
    told_apart = tokenize(rows, frequent, BUCKETS * parts).withColumn("dealt", F.col("bucket").isNotNull())
    tokens = store.put(told_apart, "tokens", by=["dealt"])
    rare_part = store.put(rare_blocks(tokens, parts), "rare")
    store.drop("tokens/dealt=true")  # the blocks hold these occurrences now
    frequent_part = store.put(frequent_blocks(frequent_cells(tokens), min(parts, 64)), "frequent")
    totals = _summed(rare_part.unionByName(frequent_part).select("totals"))
    totals = totals if len(totals) else np.zeros(N_TOTALS)
    house, m = seat_frequent(totals, seed), CONTEXTS + 1
    told = store.put(exchange(first_tellings(rare_part, house, parts), parts), "told-0")
    for number in range(ROUNDS - 1):
        cells = with_told(_cells_of(rare_part), told)
        pairs = _cells_of(frequent_part).withColumn("told", F.lit(None).cast(told.schema["told"].dataType))
        sampled = store.put(sample_tables(cells.unionByName(pairs), house, seed + number, parts), f"sampled-{number}")
        tables = _summed(sampled.where("sums IS NOT NULL").select(F.col("sums").alias("totals")))
        if len(tables):
            totals[m : 2 * m], totals[2 * m : 2 * m + 2] = tables[:m], tables[m : m + 2]
            totals[2 * m + 8 + FREQUENT : 2 * m + 8 + 2 * FREQUENT] = tables[m + 2 :]
        house = seat_frequent(totals, seed + number)
        told = store.put(exchange(sampled.where("owner IS NOT NULL").drop("sums"), parts), f"told-{number + 1}")
        store.drop(f"told-{number}", f"sampled-{number}")
    logs = frequent_probabilities(frequent_part, house, seed + ROUNDS)
    rare = rare_scores(with_told(rare_part.drop("totals"), told), house, seed + ROUNDS, parts)
    scored = frequent_scores(tokens, logs, house.counts).unionByName(rare)
    sums = scored.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("train").alias("trains"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base"),
        F.sum("score").alias("score"),
    )
    each = math.log10(house.tokens + house.words + 1.0)
    return sums.select(
        "doc_id",
        "trains",
        "n_tokens",
        "n_known",
        F.lit(int(house.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * each).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
