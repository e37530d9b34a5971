"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source asks for the same expected number of copies, its source's target over its size.  The whole
part is taken as it is; the fractional parts are rounded against each other: two documents transfer words from one to
the other, in a random direction that keeps both expectations, until one of them has 0 or 1 copies (Deville & Tillé,
"Unequal probability sampling without replacement through a splitting method").  The transfer keeps the words of the
pair, so a source misses its target by less than one document.  To make that a small one, documents with more than
1/1000 of their source's words (fewer than 1000 of a source) come first, each against the pool of all smaller ones.

The other pairs form a tree: within a block of some 48 documents the rounding is a fold that leaves one undecided document;
the undecided ones of 64 blocks form a block of the next level, and so on.  No group is larger than a block, however
large a source is, and all of it is DataFrame functions.  Randomness is a hash of the documents, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodgelens.llm.common import WORD, grows, input_rows, text_of
from lodgelens.session import StoredTables

SHARE = 1.5
MOST_COPIES = 2.0
WEIGHTS = (3.0, 1.0, 2.0)
LARGE = 1000
LEAF = 48
BRANCH = 64
RESULTS = ("size", "source_size", "target", "copies")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST_COPIES, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, documents) → with ``target``: ``share`` of all sizes by weight, capped at ``most`` times a
    source's size, the excess reshared by weight until none is above.

    Water filling: sources in order of cap per weight; the first that is not capped, given that all before it are,
    fixes the level.  One row per source, so the windows over all of them run on few rows.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumns(
        {
            "weight": F.element_at(pattern, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")),
            "cap": F.col("source_size") * F.lit(float(most)),
        }
    )
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everywhere = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    left = F.sum("source_size").over(everywhere) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = weighed.withColumn(
        "level", left / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    filled = level.withColumn("fill", F.first(free, ignorenulls=True).over(order.rowsBetween(*_all())))
    target = F.least(F.col("cap"), F.coalesce(F.col("fill") * F.col("weight"), F.col("cap")))
    return filled.select("source", "source_size", "documents", F.greatest(target, F.lit(0.0)).alias("target"))


def _all() -> tuple[int, int]:
    return W.unboundedPreceding, W.unboundedFollowing


def _let(values: dict[str, Column], then) -> Column:
    """``then`` of a struct of values that are computed once."""
    one = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.element_at(F.transform(one, then), 1)


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _decision(unit: Column, taken: Column) -> Column:
    return F.struct(unit.unit.alias("unit"), taken.cast("int").alias("taken"))


def _no_decisions() -> Column:
    return F.array().cast("array<struct<unit:struct<id:bigint,hash:bigint>,taken:int>>")


def _fold_step(state: Column, other: Column) -> Column:
    """The undecided document ``state.held`` against ``other``; one of them is decided."""
    held = state.held
    give = F.least(held.p * held.words, (1.0 - other.p) * other.words)  # words that may go from held to other
    take = F.least(other.p * other.words, (1.0 - held.p) * held.words)

    def moved(m: Column) -> Column:
        gives = m.u * (m.give + m.take) < m.take
        held_p = F.when(gives, held.p - m.give / held.words).otherwise(held.p + m.take / held.words)
        other_p = F.when(gives, other.p + m.give / other.words).otherwise(other.p - m.take / other.words)
        # which bound stopped the transfer
        held_done = F.when(gives, held.p * held.words <= m.give).otherwise((1.0 - held.p) * held.words <= m.take)
        taken = F.when(held_done, ~gives).otherwise(gives)
        left = F.least(F.greatest(F.when(held_done, other_p).otherwise(held_p), F.lit(0.0)), F.lit(1.0))
        stays = F.when(held_done, other).otherwise(held)
        gone = F.when(held_done, held).otherwise(other)
        return F.struct(
            F.struct(stays.unit.alias("unit"), stays.words.alias("words"), left.alias("p")).alias("held"),
            F.concat(state.done, F.array(_decision(gone, taken))).alias("done"),
        )

    return _let({"give": give, "take": take, "u": _uniform(held.unit, other.unit)}, moved)


def _round_blocks(units: DataFrame) -> DataFrame:
    """(source_no, block, unit, words, p) → per block: ``done`` decisions and the one document ``held``."""
    members = F.array_sort(F.collect_list(F.struct("unit", "words", "p")))
    blocks = units.groupBy("source_no", "block").agg(members.alias("units"))
    start = F.struct(F.element_at("units", 1).alias("held"), _no_decisions().alias("done"))
    folded = F.aggregate(F.slice("units", 2, F.greatest(F.size("units") - 1, F.lit(0))), start, _fold_step)
    return blocks.select("source_no", "block", folded.alias("f")).select("source_no", "block", "f.held", "f.done")


def _large_step(state: Column, x: Column) -> Column:
    """One large document against the pool of all smaller ones, whose documents share the probability ``state.p``."""
    rest = state.rest - x.words
    mass = state.p * state.rest  # words to take of this document and the pool

    def moved(m: Column) -> Column:
        gets = m.mass - x.words >= 0  # the pool can give what the document lacks
        gives = m.mass <= m.rest  # the pool can take what it has
        taken = F.when(gets == gives, m.u < state.p).otherwise(gets)
        left = (m.mass - F.when(taken, x.words).otherwise(0.0)) / F.nullif(m.rest, F.lit(0.0))
        return F.struct(
            F.least(F.greatest(F.coalesce(left, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("p"),
            m.rest.alias("rest"),
            F.concat(state.done, F.array(_decision(x, taken))).alias("done"),
        )

    return _let({"rest": rest, "mass": mass, "u": _uniform(F.lit("large"), x.unit)}, moved)


def round_large(units: DataFrame) -> DataFrame:
    """The documents with more than 1/LARGE of their source's words, so fewer than LARGE of a source, largest first.

    Each transfers words from or to the pool of all smaller documents until it has 0 or 1.  Gives per source the
    decisions ``done`` and the probability ``pool_p`` that is left for the others.
    """
    members = F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("order"), "unit", "words")))
    sources = units.groupBy("source_no").agg(
        members.alias("units"), F.first("p").alias("p"), F.first("source_size").alias("rest")
    )
    start = F.struct("p", F.col("rest").cast("double").alias("rest"), _no_decisions().alias("done"))
    folded = F.aggregate("units", start, _large_step)
    return sources.select("source_no", folded.alias("f")).select("source_no", F.col("f.p").alias("pool_p"), "f.done")


def round_copies(units: DataFrame, most_documents: int, store: StoredTables) -> DataFrame:
    """(source_no, unit, words, p, documents) with 0 < p < 1 and words > 0 → (source_no, unit, taken), which is 0 or 1."""
    blocks = F.ceil(F.col("documents") / LEAF).cast("long")
    level = units.withColumn("block", F.pmod(F.xxhash64("unit"), blocks))
    width, depth, decided = max(1, -(-most_documents // LEAF)), 0, []
    while True:
        rounded = store.put(_round_blocks(level), f"level{depth}")
        decided.append(_decided(rounded))
        held = rounded.select("source_no", "block", "held.unit", "held.words", "held.p")
        if width == 1:
            break
        level = held.withColumn("block", F.floor(F.col("block") / BRANCH))
        width, depth = -(-width // BRANCH), depth + 1
    last = (_uniform(F.lit("last"), F.col("unit")) < F.col("p")).cast("int")
    decided.append(held.select("source_no", "unit", last.alias("taken")))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out


def _decided(rounded: DataFrame) -> DataFrame:
    return rounded.select("source_no", F.explode("done").alias("d")).select("source_no", "d.unit", "d.taken")


def _source_number() -> Column:
    return F.xxhash64("source", F.col("source").isNull())


def mix_sources(
    docs: DataFrame,
    share: float = SHARE,
    most: float = MOST_COPIES,
    weights=WEIGHTS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row (or the columns ``carry``) with ``size``, ``source_size``, ``target`` and ``copies``.

    Sources stand in the order of their code points, null last, and take the weights in turn.  Sizes are numbers of
    words; a null text has none, and a document without words takes the whole part of its copies.  Rows that agree in
    id, source and text share one decision.  A null source is a source, null ids are told apart by their texts.  Input
    columns named like a result are replaced; an empty table gives an empty result.
    """
    store = StoredTables(docs.sparkSession, "mixing")
    kept = docs.select(*(docs.columns if carry is None else carry))
    rows = docs.select(
        input_rows(kept, RESULTS).alias("row"),
        F.col("source").cast("string").alias("source"),
        F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash")).alias("unit"),
        word_count(text_of()).alias("size"),
    )
    measured = store.put(rows.select("source", "unit", "size"), "measured")  # texts are counted here, and nowhere else
    sizes = measured.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")
    )
    rates = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    targets = store.put(
        source_targets(sizes, share, most, weights)
        .withColumn("rate", rates)
        .withColumns(
            {"source_no": _source_number(), "whole": F.floor("rate"), "p": F.col("rate") - F.floor("rate")}
        ),
        "targets",
    )
    named = targets.withColumnRenamed("source", "source_name")
    placed = measured.join(named, F.col("source").eqNullSafe(F.col("source_name")), "left").drop("source", "source_name")
    open_units = (
        placed.where("p > 0 AND size > 0")
        .groupBy("source_no", "unit", "size", "p", "documents", "source_size")
        .agg((F.count(F.lit(1)) * F.col("size")).cast("double").alias("words"))
    )
    is_large = F.col("words") * LARGE > F.col("source_size")
    large = store.put(round_large(open_units.where(is_large)), "large")
    pools = large.select(F.col("source_no").alias("pool_no"), "pool_p")
    pooled = open_units.where(~is_large).join(pools, F.col("source_no") == F.col("pool_no"), "left")
    small = pooled.select("source_no", "unit", "words", F.coalesce("pool_p", "p").alias("p"), "documents")
    whole = small.where("p <= 0 OR p >= 1").select("source_no", "unit", F.col("p").cast("int").alias("taken"))
    most_documents = targets.agg(F.max("documents").alias("most")).first()["most"] or 0
    rounded = round_copies(small.where("p > 0 AND p < 1"), most_documents, store)
    taken = store.put(rounded.unionByName(whole).unionByName(_decided(large)), "taken")
    once = placed.select("source_no", "unit", "size", "source_size", "target", "whole").distinct()
    copies = (F.col("whole") + F.coalesce("taken", F.lit(0))).cast("long").alias("copies")
    decisions = store.put(
        once.join(grows(taken), ["source_no", "unit"], "left").select("source_no", "unit", "size", "source_size", "target", copies),
        "decisions",
    )
    asking = rows.select("row", "unit", _source_number().alias("source_no"))
    joined = asking.join(grows(decisions), ["source_no", "unit"], "left")
    return joined.select("row.*", "size", "source_size", "target", "copies")


def take_copies(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    marked = mix_sources(docs.select(F.struct("*").alias("doc"), "doc_id", "source", "text"), carry=["doc"], **settings)
    repeated = marked.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select(*[F.col("doc").getField(n).alias(n) for n in docs.columns])
