"""Exact deduplication by distributed most-significant-digit radix partitioning.

All documents start in one group.  A round splits every group by the next bytes of its normalised texts; a group with
one document is done, a group whose texts have ended holds equal texts, and only the others go on.  A digit is 64
bytes in the first round and eight times as wide in each further one, so that texts of any length take few rounds and
no text is moved more often than there are rounds.  Equality is decided by the bytes alone; no digest is compared.

A round counts its groups before anything meets (a group of copies arrives as one row per task) and joins the groups
with several members back; adaptive execution splits a hot group, since that side of the join is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.common import grows, input_rows, text_of
from lodgelens.session import StoredTables

FIRST_BYTES = 64
GROWTH = 8
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def one_space(text: Column) -> Column:
    """Every run of blanks becomes one space; single spaces need no replacement."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")


def exact_groups(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    carry: list[str] | None = None,
    store: StoredTables | None = None,
) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``carry`` names the input columns to return (default: all).  The result reads tables of ``store`` (by default one
    of its own).  A null text counts as empty, and all empty texts are
    one group.  The smallest id of a group is kept; null ids rank last, so a group of null ids only keeps them all
    (``keep_id`` null, ``kept`` true).  Rows that repeat the kept id and its text are all kept.  Input columns named
    like a result are replaced.  An empty table gives an empty result.
    """
    store = store or StoredTables(docs.sparkSession, "exact-dedup")
    kept_columns = docs.select(*(docs.columns if carry is None else carry))
    body = one_space(text_of(text)).cast("binary")
    state = docs.select(
        input_rows(kept_columns, RESULTS).alias("row"),
        F.col(key).alias("id"),
        F.lit(0).cast("long").alias("group"),
        body.alias("body"),
        F.sha2(body, 256).alias("sha"),
    )
    done, width, depth = [], FIRST_BYTES, 0
    while True:
        keyed = state.withColumns(
            {"digit": F.substring("body", 1, width), "ended": F.length("body") <= width}
        )
        groups = store.put(
            keyed.groupBy("group", "digit", "ended")
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
            .where("n > 1")
            .withColumn("next_group", F.monotonically_increasing_id()),
            f"groups{depth}",
        )
        split = keyed.join(grows(groups), ["group", "digit", "ended"], "left")
        goes_on = F.col("n").isNotNull() & ~F.col("ended")
        stored = store.put(
            split.select(
                "row",
                "id",
                F.col("next_group").alias("group"),
                F.when(goes_on, F.substring("body", width + 1, 2**31 - 1)).alias("body"),
                "sha",
                F.coalesce("n", F.lit(1)).alias("n"),
                F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first_id")).alias("first_id"),
                goes_on.alias("goes_on"),
            ),
            f"split{depth}",
            by=["goes_on"],
        )
        store.drop(f"groups{depth}", f"split{depth - 1}/goes_on=true")
        done.append(stored.where("NOT goes_on"))
        rest = stored.where("goes_on")
        if rest.isEmpty():
            break
        state = rest.select("row", "id", "group", "body", "sha")
        width, depth = width * GROWTH, depth + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.select(
        "row.*",
        F.col("first_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.coalesce(F.col("id") == F.col("first_id"), F.col("first_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, store: StoredTables | None = None) -> DataFrame:
    """The kept rows with the columns of ``docs``."""
    columns = docs.columns
    marked = exact_groups(docs.select(F.struct("*").alias("doc"), "text", "doc_id"), carry=["doc"], store=store)
    return marked.where("kept").select(*[F.col("doc").getField(name).alias(name) for name in columns])
