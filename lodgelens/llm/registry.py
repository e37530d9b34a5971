"""The operators as queries over the given tables, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.llm import (
    chat, conversation_repair, exact_dedup, fingerprints, hard_negatives, language_id, language_model, mixing, near_dedup,
    neighbours, packing, quality, warc,
)
from lodgelens.llm.common import grows, split_number, table
from lodgelens.session import configure


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(configure(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    split = split_number("doc_id", 3)
    prototypes = language_id.learn_prototypes(docs.where(split != 1))
    marked = docs.select("doc_id", "text", (split == 1).alias("held_out"))
    return language_id.predict_language(marked, prototypes, carry=["doc_id", "held_out"])


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(configure(spark), sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    added = configure(spark).createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    formatted = chat.format_conversations(turns)
    read = formatted.select(
        "conv_id", "formatted", "valid", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("under_loss"),
    )
    newline = F.lit("\n")
    written = F.array_join(F.transform("turns", lambda t: F.concat(t.role, newline, t.text, newline)), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"),
        F.sha2("under_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *,
    CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 19 + length(role) END
      + length(text)
      + len(regexp_extract_all(text, '[\[<]\\*(/?INST\]|/?s>|<SYS>>|</SYS>>|/?ROLE\]|TEXT\])')) AS chars,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') || ' ' || role AS pair,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(pair IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user'))
    AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM marked GROUP BY conv_id
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive_pages(table(configure(spark), sf_dir, "pages"))
    archives = max(1, manifest.count())
    records = warc.read_archives(manifest.repartition(archives), keep_payload=False)
    page = lambda c: F.substring_index(c, ":", -1).cast("long")
    return records.select(
        F.when(F.col("record_id") != "urn:page:none", page(F.col("record_id"))).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
        "verified",
    )


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    scored = language_model.score_documents(docs, split_number("doc_id", 7) != 2)
    return scored.withColumn("held_out", ~F.col("trains")).drop("trains")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(configure(spark), sf_dir, "documents"), carry=["doc_id", "source"])
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    return exact_dedup.exact_groups(docs, carry=["doc_id"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_number("doc_id", 5)
    docs = table(configure(spark), sf_dir, "documents").select("doc_id", "text", (split == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.score_quality(docs, labels, ~F.col("held_out"), carry=["doc_id", "held_out"])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(configure(spark), sf_dir, "documents"), tokenizer_path())


# A plain dynamic program, row by row from the end, carrying per grammar state the least (cost, audit, repaired rows).
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(i))
), coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM coded WHERE code <> 0
), placed AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS m, left(role, 1) AS initial,
    coalesce(lag(left(role, 1)) OVER w || left(role, 1), 'su') NOT IN ('su', 'ua', 'au') AS illegal,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE 'none' END AS fault
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM placed GROUP BY conv_id
), chains AS (
  SELECT s, s AS node, 0 AS n, '' AS letters, '' AS pre, 0 AS cost FROM range(4) t(s)
  UNION ALL
  SELECT s, CASE node WHEN 2 THEN 3 ELSE 2 END, n + 1, letters || 'I',
    pre || CASE node WHEN 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END, cost + 5
  FROM chains WHERE n < 3
), keeps(initial, node, reached) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
moves AS (
  SELECT '' AS initial, s, letters || 'D' AS letters, pre, '' AS name, node AS reached, cost + 2 AS cost FROM chains
  UNION ALL
  SELECT 'any', s, letters || 'R', pre, CASE node WHEN 2 THEN 'assistant' ELSE 'user' END, CASE node WHEN 2 THEN 3 ELSE 2 END,
    cost + 1 FROM chains
  UNION ALL
  SELECT initial, s, letters || 'K', pre, 'own', reached, cost FROM chains JOIN keeps USING (node)
), listed AS (
  SELECT list({'initial': initial, 's': s, 'letters': letters, 'pre': pre, 'name': name, 'reached': reached, 'cost': cost}) AS ms
  FROM moves
), dp AS (
  SELECT DISTINCT conv_id, m + 1 AS k, [
    {'cost': 0, 'audit': '', 'said': ''}, {'cost': 10, 'audit': 'II', 'said': chr(10) || 'user:' || chr(10) || 'assistant:'},
    {'cost': 5, 'audit': 'I', 'said': chr(10) || 'assistant:'}, {'cost': 0, 'audit': '', 'said': ''}] AS v
  FROM placed
  UNION ALL
  SELECT p.conv_id, p.k, list_transform([0, 1, 2, 3], lambda s: list_sort(list_transform(
      list_filter(ms, lambda x: x.s = s AND (x.initial = '' OR (fault IN ('none', 'truncated') AND x.initial IN ('any', p.initial)))),
      lambda x: {
        'cost': x.cost + CASE WHEN x.initial <> '' AND fault = 'truncated' THEN 5 ELSE 0 END + v[x.reached + 1].cost,
        'audit': x.letters || v[x.reached + 1].audit,
        'said': x.pre || CASE x.name WHEN '' THEN '' WHEN 'own' THEN chr(10) || role || ':' || text
          ELSE chr(10) || x.name || ':' || text END || v[x.reached + 1].said}))[1])
  FROM dp JOIN placed p ON p.conv_id IS NOT DISTINCT FROM dp.conv_id AND p.k = dp.k - 1, listed
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v[1].cost, 0) AS BIGINT) AS cost,
  coalesce(v[1].audit, '') AS audit, sha256(coalesce(substr(v[1].said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM i.conv_id AND dp.k = 1
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(configure(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    audits, repaired = conversation_repair.repair_conversations(conversation_repair.damaged(turns))
    ids, digests = turns.select("conv_id").distinct(), conversation_repair.digests(repaired).withColumnRenamed("conv", "of")
    found = ids.join(grows(audits.drop("pieces")), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    joined = found.join(grows(digests), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id",
        *zero,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


OP12_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(configure(spark), sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where(finite).select("vec_id", label.alias("label"), scaled.alias("vector"))
    return hard_negatives.mine(whole, F.col("vec_id") % 100 == 0)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents").select("doc_id", "text")
    compared = fingerprints.with_next(docs, carry=["doc_id"])
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text("sketch").alias("fingerprint"),
        fingerprints.as_text("edited_sketch").alias("edited_fingerprint"),
        fingerprints.likeness("sketch", "edited_sketch").alias("near_edited"),
        fingerprints.likeness("sketch", "next_sketch").alias("near_next"),
        fingerprints.containment("sketch", "edited_sketch").alias("held_by_edited"),
        fingerprints.containment("sketch", "next_sketch").alias("held_by_next"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_neighbours, op2_language_id, op3_near_dedup, op4_chat_format, op5_warc, op6_language_model, op7_mixing,
        op8_exact_dedup, op9_quality, op10_packing, op11_conversation_repair, op12_hard_negatives, op13_fingerprints,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_format": OP4_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op11_conversation_repair": OP11_SQL,
        "op12_hard_negatives": OP12_SQL,
    }
