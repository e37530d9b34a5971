"""Operators without SQL against plain Python over the whole query, and the pipeline's stages on hard rows."""

import base64
import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import TESTDATA
from lodgelens.llm import language_id, mixing, quality, registry
from lodgelens.llm.common import text_of


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"select doc_id, coalesce(text, ''), lang, source from '{TESTDATA}/documents.parquet'").fetchall()
    return {i: (text, lang, source) for i, text, lang, source in rows}


def test_payload_digests_and_verification(spark):
    pages = dict(duckdb.sql(f"select page_id, coalesce(html, '') from '{TESTDATA}/pages.parquet'").fetchall())
    got = {r["page_id"]: r for r in registry.op5_warc(spark, TESTDATA).collect()}
    assert got.keys() == pages.keys()
    for i, html in pages.items():
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert got[i]["verified"]


def plain_vector(text, dimensions):
    """A document's vector trigram by trigram, with its letters' vectors rolled and multiplied one at a time."""
    spaced = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    total = np.zeros(dimensions)
    letters = {}
    for c in set(spaced):
        random = np.random.Generator(np.random.PCG64([7, ord(c)]))
        letters[c] = random.integers(0, 2, dimensions, dtype=np.int8).astype(int) * 2 - 1
    grams = collections.Counter(spaced[k : k + 3] for k in range(len(spaced) - 2))
    for (a, b, c), n in grams.items():
        total += n * (np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c])
    return total


def test_languages_equal_plain_profiles(spark, documents):
    import zlib

    dimensions, prototypes = language_id.DIMENSIONS, {}
    vectors = {i: plain_vector(text, dimensions) for i, (text, _, _) in documents.items()}
    for i, (_, lang, _) in documents.items():
        if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            prototypes[lang] = prototypes.get(lang, 0) + vectors[i]
    names = sorted(prototypes)
    for r in registry.op2_language_id(spark, TESTDATA).collect():
        text = documents[r["doc_id"]][0]
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == (language_id.UNKNOWN, 0.0)
            continue
        v = vectors[r["doc_id"]]
        cosine = np.array([v @ prototypes[n] / np.linalg.norm(v) / np.linalg.norm(prototypes[n]) for n in names])
        weight = np.exp(language_id.SHARPNESS * (cosine - cosine.max()))
        assert r["lang_pred"] == names[int(cosine.argmax())]
        assert r["score"] == pytest.approx(weight.max() / weight.sum(), abs=1e-6)


def test_letter_vectors_are_bounded_and_the_same_after_they_were_dropped(monkeypatch):
    monkeypatch.setattr(language_id, "LETTERS", 3)
    few, many = language_id.TrigramEncoder(64), language_id.TrigramEncoder(64)
    texts = ["abcdefg hij", "日本語 テキスト", "ab ab ab"]
    got = few.encode(texts)[0]
    assert len(few.letter) <= 3
    monkeypatch.setattr(language_id, "LETTERS", 1000)
    assert (many.encode(texts)[0] == got).all()


def test_mix_sizes_targets_and_copies(spark, documents):
    """Sizes and targets by the definition; every document is taken the whole part of its rate, or once more."""
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text)) for i, (text, _, _) in documents.items()}
    total = collections.Counter()
    for i, (_, _, source) in documents.items():
        total[source] += words[i]
    names = sorted(s for s in total if s is not None) + [s for s in total if s is None]
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while free:
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if shares[s] > 2 * total[s]}
        for s in over or free:
            target[s] = 2 * total[s] if over else shares[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = collections.Counter()
    rows = registry.op7_mixing(spark, TESTDATA).collect()
    assert len(rows) == len(documents)
    for r in rows:
        source = documents[r["doc_id"]][2]
        assert (r["size"], r["source_size"]) == (words[r["doc_id"]], total[source])
        assert r["target"] == pytest.approx(target[source])
        rate = target[source] / total[source]
        assert r["copies"] in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9)) and r["taken"] == r["copies"] * r["size"]
        taken[source] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(max(words[i] for i, d in documents.items() if d[2] == s), 0.01 * target[s])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, registry.op7_mixing(spark, TESTDATA).collect()))


def test_texts_are_counted_once(spark):
    """The word count stands in one stored table; the rest of the plan reads that."""
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    plan = mixing.mix_sources(docs, carry=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "regexp_count" not in plan and "regexp_extract_all" not in plan and "\\x09-\\x0D" not in plan


def test_quality_scores_equal_rules_evaluated_one_by_one(spark, documents):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text")
    names = list(quality.statistics(F.lit("")))
    measured = docs.select("doc_id", *[c.alias(n) for n, c in quality.statistics(text_of()).items()]).collect()
    bounds = [("log_words", ">", 3.0), ("stops", "<=", 0.1), ("new_words", ">", 0.5), ("capitals", "<=", 0.2)]
    assert {n for n, _, _ in bounds} <= set(names)
    model = quality.RuleModel(-0.3, ((0.7, tuple(bounds[:2])), (-1.2, tuple(bounds[2:])), (0.4, (bounds[0], bounds[3]))))
    scored = spark.createDataFrame(measured).select("doc_id", model.score().alias("score")).collect()
    by_id = {r["doc_id"]: r for r in measured}
    for r in scored:
        holds = lambda rule: all(
            by_id[r["doc_id"]][n] <= b if side == "<=" else by_id[r["doc_id"]][n] > b for n, side, b in rule
        )
        total = model.intercept + sum(w for w, rule in model.rules if holds(rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))


# -- the pipeline's stages on hard rows ----------------------------------------------------------------------

STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, size int"
LONG = " ".join(f"word{n}" for n in range(20_000))
HARD = [
    (1, "the cat sat on the mat with a hat", "en", "s1", 1, True, "x", 1),
    (2, "the cat  sat on the mat with a hat", "en", "s1", 1, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "fr", "s2", 0, False, "y", 2),
    (5, LONG, "en", "s1", 1, True, "x", 1),
    (5, LONG, "en", "s1", 1, True, "x", 1),
    (6, LONG + " more", "en", None, 1, True, "x", 1),
    (None, "le la les un une des du", "fr", None, 1, True, "x", 1),
    (7, "!!! 123", "fr", "s2", 1, True, "x", 1),
]


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"])
def test_stages_on_nulls_repeats_empty_tables_and_extra_columns(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame(HARD, STAGE_SCHEMA).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = stage(spark, docs, TESTDATA)
    ids = sorted((r["doc_id"] or 0 for r in out.select("doc_id").collect()))
    if name != "packing":
        assert out.columns == docs.columns
    expected = {
        "language_id": [0, 1, 2, 5, 5, 6],
        "exact_dedup": [0, 1, 3, 5, 5, 6, 7],
        "near_dedup": [0, 1, 3, 4, 5, 5, 7],
    }
    if name in expected:
        assert ids == expected[name]
    elif name == "packing":
        assert set(ids) == {0, 1, 2, 3, 4, 5, 6, 7}
    else:
        assert set(ids) <= {0, 1, 2, 3, 4, 5, 6, 7} and {5, 6} & set(ids)
    assert stage(spark, docs.limit(0), TESTDATA).count() == 0
