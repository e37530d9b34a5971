"""Conversation repair, hard negatives and fingerprints: against brute force, and on nulls, repeats and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import TESTDATA
from lodgelens.llm import conversation_repair as repair
from lodgelens.llm import fingerprints, hard_negatives, registry

# -- conversation repair -------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, fault string, audit int, conv long"


def all_edits(symbols):
    """Cheapest cost and ASCII-least audit by listing every choice of edits, with up to two inserts at each place."""
    found = []
    per_row = [[("D", ""), ("K", i), ("R", "u"), ("R", "a")] if f in (0, 3) else [("D", "")] for i, f in symbols]
    inserts = ["".join(x) for n in range(3) for x in itertools.product("ua", repeat=n)]
    for choice in itertools.product(*per_row):
        for added in itertools.product(inserts, repeat=len(symbols) + 1):
            roles = added[0] + "".join(r + extra for (_, r), extra in zip(choice, added[1:]))
            if not re.fullmatch("(s?(ua)+)?", roles):
                continue
            audit = "I" * len(added[0]) + "".join(e + "I" * len(x) for (e, _), x in zip(choice, added[1:]))
            cost = 5 * audit.count("I") + 2 * audit.count("D") + audit.count("R")
            cost += sum(5 for (e, _), (_, f) in zip(choice, symbols) if f == 3 and e != "D")
            found.append((cost, audit))
    return min(found)


def in_runs(symbols):
    return [[(i, f, len(list(g))) for (i, f), g in itertools.groupby(symbols)]]


def test_edits_equal_every_listed_choice():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(12 if n == 3 else 30):
            symbols = [(rng.choice("suaat"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(n)]
            cost, pieces = repair.cheapest_edits(in_runs(symbols))
            assert (cost, "".join(x for _, x in pieces)) == all_edits(symbols)


def plain_program(symbols):
    """The same least (cost, audit), row by row from the end, without runs or powers."""
    best = [(0, ""), (10, "II"), (5, "I"), (0, "")]
    for symbol in reversed(symbols):
        now = []
        for state in range(4):
            options, at, lead = [], state, ""
            for _ in range(4):
                for letter, cost, to in repair.edits(symbol, at):
                    options.append((5 * len(lead) + cost + best[to][0], lead + letter + best[to][1]))
                at, lead = repair.NEXT[at], lead + "I"
            now.append(min(options))
        best = now
    return best[0]


def test_long_runs_and_chunks_equal_the_plain_program():
    rng = random.Random(2)
    symbols = []
    for _ in range(40):
        symbols += [(rng.choice(("s", "u", "a", "")), rng.choice((0, 0, 3, 1)))] * rng.choice((1, 1, 2, 7, 100))
    runs = in_runs(symbols)[0]
    cost, pieces = repair.cheapest_edits([runs[:13], runs[13:14], runs[14:]])
    assert (cost, "".join(x for _, x in pieces)) == plain_program(symbols)
    assert [s for s, _ in pieces][0] == repair.START


def test_repair_on_nulls_ties_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 2)
    rows = [
        (1, 0, "system", "Be kind.", "x", 1, 9),
        (1, 1, "user", "Hi there.", None, None, None),
        (1, 2, "user", "Are you there?", None, None, None),
        (1, 5, "assistant", "Yes, I", None, None, None),
        (1, 6, "user", "Hi there.", None, None, None),
        (1, 7, "user", None, None, None, None),
        (2, None, None, "Odd role.", None, None, None),
        (2, None, "assistant", "Fine.", None, None, None),
        (3, 1, "", "No role.", None, None, None),
        (None, 4, "user", "Lost.", None, None, None),
        (None, 4, "user", "Lost.", None, None, None),
        (4, 0, "assistant", "  \t", None, None, None),
    ]
    turns = spark.createDataFrame(rows, TURNS)
    audits, repaired = repair.repair_conversations(turns)
    got = {r["conv"]: tuple(r)[1:8] for r in audits.collect()}
    # gaps, blank, duplicate, truncated, illegal, cost, audit
    assert got[1] == (2, 1, 1, 1, 2, 7, "KKRDDD")
    assert plain_program([("s", 0), ("u", 0), ("u", 0), ("a", 3), ("u", 2), ("u", 1)]) == (7, "KKRDDD")
    assert got[2] == (0, 0, 0, 0, 1, 1, "RK")
    assert got[3][5:] == plain_program([("", 0)]) == (2, "D")
    assert got[None] == (0, 0, 1, 0, 1, 4, "DD")
    assert got[4] == (0, 1, 0, 0, 0, 2, "D")
    told = {}
    for r in sorted(repaired.collect(), key=lambda r: (str(r["conv"]), r["chunk"], r["place"])):
        told.setdefault(r["conv"], []).append((r["role"], r["text"], r["edit"]))
    assert told[2] == [("user", "Odd role.", "R"), ("assistant", "Fine.", "K")]
    for roles in told.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _, _ in roles))
    shas = {r["conv"]: r["sha"] for r in repair.digests(repaired).collect()}
    assert shas[2] == hashlib.sha256(b"user:Odd role.\nassistant:Fine.").hexdigest()
    assert shas.keys() == told.keys()
    empty = repair.repair_conversations(spark.createDataFrame([], TURNS))
    assert [part.count() for part in empty] == [0, 0]


def test_a_hot_conversation_is_dealt_over_many_tasks(spark):
    """A conversation of 20,000 turns is summarised by ranges of turn numbers, and its audit is the plain program's."""
    turns = spark.range(20_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("turn "), "id", F.lit(".")).alias("text"),
    )
    row = repair.audit_conversations(turns).first()
    assert len(row["pieces"]) == 5 and "".join(p["letters"] for p in row["pieces"]) == row["audit"]
    assert (row["cost"], row["audit"]) == plain_program([("a" if n % 3 == 0 else "u", 0) for n in range(20_000)])


def test_repair_query_has_every_conversation_and_defined_empties(spark):
    got = registry.op11_conversation_repair(spark, TESTDATA)
    rows = {r["conv_id"]: r for r in got.collect()}
    turns = duckdb.sql(f"select conv_id, turn from '{TESTDATA}/conversations.parquet'").fetchall()
    assert rows.keys() == {c for c, _ in turns} and len(rows) == got.count()
    alive = {c for c, t in turns if zlib.crc32(f"{c}:{t}".encode()) % 20}
    for c in rows.keys() - alive:
        assert rows[c]["audit"] == "" and rows[c]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


# -- hard negatives ----------------------------------------------------------------------------------------------


def brute_force(rows, anchors):
    """``rows``: (vec_id, label, vector) distinct; by the definition."""
    def best(points, size):
        return sorted(points, key=lambda p: (-p[1], p[0]))[:size]

    out = set()
    for a, label, v in anchors:
        scored = [(i, sum(x * y for x, y in zip(v, w)), l) for i, l, w in rows if i != a and len(w) == len(v)]
        for p, ps, _ in best([s for s in scored if s[2] == label], 5):
            low = [s for s in scored if s[2] != label and 80 * ps <= 100 * s[1] <= 100 * ps]
            out |= {(a, p, k, n, ps, ns) for k, (n, ns, _) in enumerate(best(low, 5), 1)}
    return out


def test_intervals_hold_the_true_products_and_leave_most_rows_out():
    rng = np.random.default_rng(3)
    for dim in (1, 3, 64, 100):
        vectors = np.floor(rng.normal(size=(2000, dim)) * 256 / dim**0.5).astype(np.int64)
        vectors[:3] = 0
        codes, parts = hard_negatives.encode(vectors)
        for anchor in vectors[::400]:
            planes = hard_negatives.Anchor(0, 0, 0, anchor, []).planes()
            true, length = vectors @ anchor, float(np.linalg.norm(anchor))
            for n, point in enumerate(true[:300]):
                one = hard_negatives.candidates(planes, length, codes[:, :, n : n + 1], parts[:, :, n : n + 1], point, point)
                assert len(one) == 1
            wanted = np.sort(true)[-6]
            near = hard_negatives.candidates(planes, length, codes, parts, float(wanted), float("inf"))
            assert set(np.flatnonzero(true >= wanted)) <= set(near)
            if dim >= 64 and wanted > 0:
                assert len(near) < 0.05 * len(vectors)


VECTORS = "vec_id long, label long, vector array<long>, anchor_id long, score double, codes string"


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_mined_rows_equal_brute_force(spark, block_bytes):
    rng = np.random.default_rng(5)
    rows = [(n, int(rng.integers(3)), [int(x) for x in rng.integers(-9, 30, size=6)]) for n in range(300)]
    rows += [(300 + n, n % 3, list(rows[n][2])) for n in range(20)]  # equal vectors: ties
    rows += [(400, 1, [1, 2, 3]), (401, 1, [2, 2, 2]), (402, 2, [1, 2, 2]), (403, 0, []), (404, 1, [0] * 6)]
    odd = [(None, 1, [1] * 6), (500, None, [1] * 6), (501, 1, None), (502, 1, [1, None, 1, 1, 1, 1])]
    table = spark.createDataFrame([(*r, 7, 0.5, "x") for r in [*rows, *rows[:150], *odd]], VECTORS).repartition(5)
    marked = F.col("vec_id") % 50 == 0
    got = hard_negatives.mine(table, marked, block_bytes=block_bytes).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_force(rows, [r for r in rows if r[0] % 50 == 0])


def test_mining_large_components_empty_tables_and_no_anchor(spark):
    big = 2**31
    rows = [(0, 1, [big, 1]), (1, 1, [1, big]), (2, 2, [1, big - 1]), (3, 2, [1, 0])]
    table = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")
    assert {tuple(r) for r in hard_negatives.mine(table, F.col("vec_id") == 0).collect()} == brute_force(rows, rows[:1])
    assert hard_negatives.mine(table, F.col("vec_id") == 9).count() == 0
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") == 0).count() == 0


# -- fingerprints ------------------------------------------------------------------------------------------------


def signed(n):
    return n - 2**64 if n >= 2**63 else n


def sketch_of(text, scale=fingerprints.SCALE):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    found = set()
    for k in range(max(len(words) - 4, 1) if words else 0):
        h = 42
        for x in hashes[k : k + 5]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=h)
        found.add(signed(h))
    low = {h for h in found if h < fingerprints.threshold(scale)}
    return low or ({min(found)} if found else set())


def told(sketch):
    return "".join(f"{h % 2**64:016x}" for h in sorted(sketch))


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(texts):
    """By doc_id: the query's first seven columns, from the definition."""
    out, ids = {}, sorted(texts)
    for i, after in zip(ids, [*ids[1:], *ids[:1]]):
        text, half = texts[i], len(texts[i]) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        a, b, c = sketch_of(text), sketch_of(edited), sketch_of(texts[after])
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), told(a), told(b), alike(a, b), alike(a, c))
    return out


@pytest.mark.parametrize("per_range", [fingerprints.DOCS_PER_RANGE, 1, 3])
def test_fingerprint_query_equals_brute_force(spark, monkeypatch, per_range):
    """At three widths of the id ranges, so that every row is at a range's end, or many are."""
    monkeypatch.setattr(fingerprints, "DOCS_PER_RANGE", per_range)
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{TESTDATA}/documents.parquet'").fetchall())
    got = {r["doc_id"]: tuple(r)[1:7] for r in registry.op13_fingerprints(spark, TESTDATA).collect()}
    want = expected(texts)
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i][:4] == row[:4]
        assert got[i][4:] == pytest.approx(row[4:])


def test_likeness_estimates_true_resemblance_of_long_texts(spark):
    words = [f"w{n}" for n in range(8000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:4000] + ["x"] + words[4001:])), (3, " ".join(words[2000:3000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.with_next(docs).select(
        "doc_id", fingerprints.likeness("sketch", "next_sketch").alias("near"),
        fingerprints.containment("next_sketch", "sketch").alias("held"),
        F.array_sort(fingerprints.merged(F.col("sketch"), F.col("next_sketch"))).alias("both"),
    )
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[1]["near"] > 0.99 and by_id[2]["held"] == 1.0 and abs(by_id[2]["near"] - 0.125) < 0.03
    assert set(by_id[2]["both"]) == sketch_of(rows[1][1]) | sketch_of(rows[2][1])


def test_fingerprints_on_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, sketch string, id long, body string, n_chars int, part int"
    rows = [
        (1, "One two three", "s", 5, "b", 1, 1), (1, "One two three", "s", 5, "b", 1, 1), (4, None, None, None, None, None, None),
        (9, " \t ", "s", 5, "b", 1, 1), (None, "lost words here", "s", 5, "b", 1, 1), (12, "one TWO three", "s", 5, "b", 1, 1),
        (13, "naïve Ünïcode 😀 text", "s", 5, "b", 1, 1),
    ]
    got = fingerprints.with_next(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["id"] for r in by_id[1]] == [5, 5] and {r["next_id"] for r in by_id[1]} == {1, 4}
    assert by_id[4][0]["n_chars"] == 0 and by_id[4][0]["edited"] == "" and by_id[4][0]["sketch"] == []
    assert by_id[None][0]["edited"] == "lost wor" and by_id[None][0]["next_id"] is None
    assert by_id[12][0]["sketch"] == by_id[1][0]["sketch"] and by_id[12][0]["edited"] == "one TWOnaïve "
    assert by_id[13][0]["next_id"] == 1 and by_id[13][0]["edited"] == "naïve Ünïc" + "One two th"
    single = fingerprints.with_next(spark.createDataFrame(rows[-1:], schema)).first()
    assert single["next_id"] == 13 and single["sketch"] == single["next_sketch"]
    assert fingerprints.with_next(spark.createDataFrame([], schema)).count() == 0


def test_fingerprint_query_runs_no_python_worker(spark):
    plan = registry.op13_fingerprints(spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|mapPartitions", plan)
