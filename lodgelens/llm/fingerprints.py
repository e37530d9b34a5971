"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the document's and the
sketches of very unequal documents still estimate what share of one is contained in the other.  Sketches merge by union.
So that no document with words goes without, one whose hashes all lie above the threshold keeps its least hash alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.llm.common import SPACE, input_rows, lower_ascii, quoted, text_of

WORDS = 5  # words in a shingle
SCALE = 4  # every hash in the lowest 1/SCALE of the range is kept
DOCS_PER_RANGE = 512  # documents that one range of ids should hold
MOST_RANGES = 1 << 16
RESULTS = ("n_chars", "edited", "sketch", "edited_sketch", "next_sketch", "next_id")


def threshold(scale: int) -> int:
    """Signed 64-bit hashes below this are kept."""
    return -(2**63) + 2**64 // scale


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """``df`` with the sketch of a text column: an ascending array of 64-bit hashes.

    Words are runs of other characters than blanks, A-Z in lower case; a text of fewer words than a shingle is one
    shingle, a text without words (or a null) has an empty sketch.
    """
    parts = F.split(F.regexp_replace(lower_ascii(text_of(text)), f"^[{SPACE}]+|[{SPACE}]+$", ""), f"[{SPACE}]+")
    hashed = F.when(~text_of(text).rlike(f"[^{SPACE}]"), F.array().cast("array<bigint>")).otherwise(
        F.transform(parts, lambda w: F.xxhash64(w))
    )
    places = F.sequence(F.lit(0), F.greatest(F.size("_words") - words, F.lit(0)))
    shingle = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(words)])
    shingles = F.when(F.size("_words") == 0, F.col("_words")).otherwise(F.transform(places, shingle))
    low = F.array_sort(F.array_distinct(F.filter("_shingles", lambda h: h < threshold(scale))))
    least = F.when(F.size("_shingles") == 0, F.col("_shingles")).otherwise(F.array(F.array_min("_shingles")))
    out = df.withColumn("_words", hashed).withColumn("_shingles", shingles).withColumn("_low", low)
    kept = F.when(F.size("_low") == 0, least).otherwise(F.col("_low"))
    return out.withColumn(name, kept).drop("_words", "_shingles", "_low")


def merged(sketch: Column, other: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents' shingles together."""
    union = F.array_sort(F.array_union(sketch, other))
    low = F.filter(union, lambda h: h < threshold(scale))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(union, 1, 1))


def likeness(sketch: str, other: str) -> Column:
    """Estimated share of common shingles among all shingles of both; two texts without words are alike."""
    common = F.size(F.array_intersect(sketch, other))
    return F.coalesce(F.try_divide(common, F.size(sketch) + F.size(other) - common), F.lit(1.0))


def containment(sketch: str, other: str) -> Column:
    """Estimated share of the first one's shingles that the other has; a text without words is held by any."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(sketch, other)), F.size(sketch)), F.lit(1.0))


def as_text(sketch: str) -> Column:
    """16 hexadecimal digits a hash, joined."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def range_starts(docs: DataFrame, key: str) -> list[int]:
    """Ids (of rows that exist) at which ranges of about ``DOCS_PER_RANGE`` documents start; the least id comes first.

    One aggregate; at most ``MOST_RANGES`` numbers reach the driver.
    """
    n = docs.where(quoted(key).isNotNull()).count()
    ranges = min(MOST_RANGES, -(-n // DOCS_PER_RANGE))
    if ranges == 0:
        return []
    cuts = [i / ranges for i in range(ranges)]
    row = docs.agg(F.percentile_approx(quoted(key), cuts, 8 * ranges + 100), F.min(quoted(key))).first()
    return sorted({*row[0], row[1]})


def _range_of(key: Column, starts: list[int]) -> Column:
    """Position of the last start that is not above the key: first among every 256th start, then among those behind it."""
    wide = 256
    heads, groups = starts[::wide], [starts[i : i + wide] for i in range(0, len(starts), wide)]
    below = lambda numbers: F.size(F.filter(numbers, lambda b: b <= key))
    group = below(F.lit(heads).cast("array<bigint>")) - 1
    if len(groups) == 1:
        return below(F.lit(starts).cast("array<bigint>")) - 1
    inside = F.element_at(F.array(*[F.lit(g).cast("array<bigint>") for g in groups]), group + 1)
    return group * wide + below(inside) - 1


def with_next(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    scale: int = SCALE,
    words: int = WORDS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with its sketch, its edited text's, and its next document's.

    ``carry`` names the input columns to return (default: all).

    The next document is the one behind it by ascending id (rows of equal id by text; after the last: the first).  The
    edited text has the last floor(n / 2) of its n code points replaced by the first as many (or all) of the next
    document.  Adds ``n_chars``, ``edited``, ``sketch``, ``edited_sketch``, ``next_sketch``, ``next_id``; input columns
    of those names are replaced.  Null texts are empty.  Rows with a null id have no next document and are none's next:
    their next text is empty.  A single document is its own next.  An empty table gives no rows.

    Ids are cut into ranges that start at ids of existing rows.  So a row knows by its id alone whether it starts a
    range, and then goes to the range before as well, to follow that one's last row: texts are shuffled once, and no
    window spans all rows.
    """
    starts = range_starts(docs, key)
    base = docs.select(
        input_rows(docs.select(*(docs.columns if carry is None else carry)), RESULTS).alias("row"),
        quoted(key).cast("long").alias("id"),
        text_of(text).alias("body"),
    )
    if not starts:
        starts = [0]
    own = _range_of(F.col("id"), starts)
    before = F.pmod(own - 1, F.lit(len(starts)))
    starts_range = F.array_contains(F.lit(starts).cast("array<bigint>"), F.col("id"))
    place = lambda part, follows: F.struct(part.cast("long").alias("part"), F.lit(follows).alias("follows"))
    # Rows without an id are dealt by their text, each as a range of its own.
    alone = place(-1 - F.pmod(F.xxhash64("body"), F.lit(1 << 20)), False)
    places = (
        F.when(F.col("id").isNull(), F.array(alone))
        .when(starts_range, F.array(place(own, False), place(before, True)))
        .otherwise(F.array(place(own, False)))
    )
    dealt = base.select("*", F.inline(places)).repartition("part")
    sketched = with_sketch(dealt, "body", "sketch", scale, words)
    order = Window.partitionBy("part").orderBy("follows", "id", "body")
    known = F.col("id").isNotNull()
    after = sketched.select(
        "row", "id", "body", "sketch", "follows",
        F.coalesce(F.when(known, F.lead("body").over(order)), F.lit("")).alias("next_body"),
        F.when(known, F.lead("sketch").over(order)).alias("next_sketch"),
        F.when(known, F.lead("id").over(order)).alias("next_id"),
    ).where(~F.col("follows"))
    length = F.char_length("body")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), length - half), F.substring("next_body", F.lit(1), half))
    counted = after.withColumn("n_chars", length.cast("long")).withColumn("edited", edited)
    full = with_sketch(counted, "edited", "edited_sketch", scale, words)
    empty = F.array().cast("array<bigint>")
    return full.select(
        "row.*", "n_chars", "edited", "sketch", "edited_sketch", F.coalesce("next_sketch", empty).alias("next_sketch"), "next_id",
    )
