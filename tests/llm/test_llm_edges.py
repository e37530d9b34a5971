"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodgelens.llm import (
    chat, exact_dedup, language_id, language_model, mixing, near_dedup, neighbours, packing, quality, registry, warc,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, score int"
LONG = " ".join(f"word{n}" for n in range(30_000))
ROWS = [
    (1, "a b c d e f g", "en", "s1", 7, True, "x", 1),
    (2, "a  b\tc d e f g", "en", "s1", 7, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "fr", "s2", 0, False, "y", 2),
    (5, LONG, "en", "s1", 1, True, "x", 1),
    (5, LONG, "en", "s1", 1, True, "x", 1),
    (None, "le la les un une", "fr", None, 1, True, "x", 1),
    (7, "!!! 123", "fr", "s2", 1, True, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, empty):
    got = [(r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()]
    assert len(got) == len(ROWS)
    assert set(got) == {
        (1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 2, True), (0, None, 1, True), (7, 7, 1, True),
    }
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_long_common_prefix_splits_late(spark):
    rows = [(1, "p" * 5000 + "a"), (2, "p" * 5000 + "b"), (3, "p" * 5000), (4, "p" * 5000 + "a")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 1}


def test_near_groups(docs, empty):
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_groups(docs).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True)
    assert got[5] == (29_996, 5, True) and got[None] == (1, None, True) and got[7] == (1, 7, True)
    assert near_dedup.near_groups(empty).count() == 0
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1


def test_large_nodes_branch_and_lose_nothing(spark, monkeypatch):
    """With tiny leaves and few levels, a group larger than a leaf goes through leaders, branching and blocks."""
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    monkeypatch.setattr(near_dedup, "MAX_DEPTH", 3)
    base = [f"w{n}" for n in range(60)]
    rows = [(n, " ".join(base[: 50 + n % 10])) for n in range(20)] + [(100 + n, f"other {n} " + " ".join(base[:8])) for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs, trees=3).collect()}
    assert got == label


def test_language(docs, empty):
    prototypes = language_id.learn_prototypes(docs)
    assert set(prototypes) == {"en", "fr"}
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict_language(docs, prototypes).collect()]
    guess = {i: lang for i, lang, _ in got}
    assert guess[1] == "en" and guess[None] == "fr" and guess[3] == guess[4] == guess[7] == "und"
    assert all(0 <= s <= 1 for _, _, s in got) and len(got) == len(ROWS)
    nothing = language_id.learn_prototypes(empty)
    assert nothing == {} and language_id.predict_language(docs, nothing).where("lang_pred <> 'und'").count() == 0


def test_trigram_vectors_do_not_depend_on_chunks(monkeypatch):
    encoder = language_id.TrigramEncoder(64)
    whole = encoder.encode([LONG[:5000], "abc"])[0]
    monkeypatch.setattr(language_id, "CHUNK", 101)
    assert (encoder.encode([LONG[:5000], "abc"])[0] == whole).all()


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["copies"] <= 2 for r in got)
    assert mixing.mix_sources(empty).count() == 0
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.take_copies(docs).columns == docs.columns


def test_targets_are_filled_like_reshared_weights(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 90}
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, documents long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    weights, total = {"a": 3.0, "b": 1.0, "c": 2.0, None: 3.0}, 1.5 * sum(sizes.values())
    capped: set = set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped)
        want = {s: 2.0 * sizes[s] if s in capped else left * weights[s] / free for s in sizes}
        over = {s for s in sizes if s not in capped and want[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(want)


def test_tree_rounding_keeps_words(spark, tmp_path):
    rows = [(n, f"s{n % 2}", " ".join(["w"] * (1 + n * 7 % 13))) for n in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sums = mixing.mix_sources(docs, share=0.7).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    assert all(abs(r["taken"] - r["target"]) <= 14 for r in sums.collect())


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in ROWS}
    for r in got:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(len(ids[i]) for i, *_ in ROWS)
    at: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048 and packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("text", ["Über-ÉCOLE it's “x” ǅ İstanbul", "a.b,c... %%% <|endoftext|> z", "ΣΟΦΟΣ 12½ é   x y", "!!! ..a'"])
def test_words_encode_like_whole_texts(text):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.WordEncoder(path).encode(text), "<u4").tolist() == ids


def test_sum_of_squares_takes_the_smallest_change():
    random = np.random.default_rng(1)
    levels = packing.SumOfSquares(16)
    for size in random.integers(1, 16, 500).tolist():
        before = levels.counts.copy()
        levels.place(size, None)
        best = min(
            _squares(before, h, size) for h in range(17 - size) if h == 0 or before[h]
        )
        assert int((levels.counts**2).sum()) == best


def _squares(counts, level, size):
    after = counts.copy()
    if level:
        after[level] -= 1
    if level + size < len(after) - 1:
        after[level + size] += 1
    return int((after**2).sum())


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (4, None), (5, 1)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels, F.lit(True)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    none = quality.score_quality(docs, labels.limit(0), F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_quality(empty, labels, F.lit(True)).count() == 0


def test_tree_rules():
    text = "Tree\n  If (feature 0 <= 0.5)\n   If (feature 1 > 2.0)\n    Predict: 0.0\n   Else (feature 1 <= 2.0)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    a, b = ("a", "<=", 0.5), ("b", ">", 2.0)
    assert quality.tree_rules(text, ["a", "b"]) == [(a,), (a, b), (a, ("b", "<=", 2.0)), (("a", ">", 0.5),)]


def test_language_model(docs, empty):
    got = language_model.score_documents(docs, F.col("doc_id") != 7).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ROWS) and by[3]["n_tokens"] == by[4]["n_tokens"] == 1
    assert by[7]["n_known"] == 1 and by[1]["n_known"] == 8 and not by[None]["trains"]
    assert all(r["score"] < 0 for r in got)
    assert language_model.score_documents(empty, F.lit(True)).count() == 0
    untrained = language_model.score_documents(docs, F.lit(False)).collect()
    assert {r["score"] for r in untrained} == {r["base_score"] for r in untrained} == {0.0}


def test_predictive_probabilities_sum_to_one():
    house = language_model.Restaurants(np.zeros(language_model.N_TOTALS))
    customers, context, word = np.array([5, 1, 2, 400]), np.array([0, 1, 0, 1]), np.array([0, 0, 1, 2])
    batch = language_model._block(word, context, customers, np.zeros(0, np.int64), np.zeros(0, np.int64))
    totals = np.array(batch.column(7)[0].as_py())
    house = language_model.Restaurants(totals)
    seating = language_model.Seating(next(language_model._blocks_of(batch)), house, 1)
    m = language_model.CONTEXTS + 1
    for _ in range(5):
        seating.sweep()
        totals[m : 2 * m] = np.bincount(context, weights=seating.tables, minlength=m)
        totals[2 * m : 2 * m + 2] = seating.root_customers().sum(), seating.root_tables.sum()
        now = language_model.Restaurants(totals)
        root = now.root_probability(seating.root_customers(), seating.root_tables)
        unknown = now.root_probability(np.zeros(1), np.zeros(1))[0]
        assert root.sum() + unknown == pytest.approx(1.0)
        assert (seating.tables <= customers).all() and (seating.tables >= 1).all()


def test_every_previous_word_has_its_restaurant(spark):
    """Word n is always followed by its partner, also where neither is frequent."""
    n = language_model.FREQUENT
    pairs = [f"w{i} p{i}" for i in range(n)]
    texts = [" ".join(pairs[i : i + 8] * 3) for i in range(0, n, 8)]
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(texts, n)], "doc_id long, text string")
    got = language_model.score_documents(docs, F.col("doc_id") < n).where("NOT trains").collect()
    assert len(got) == n // 8 and all(r["n_known"] == r["n_tokens"] == 49 for r in got)
    # each word but the last has one successor; where contexts are shared, a word is one of 8192
    assert max(r["perplexity"] for r in got) < 20


def test_probabilities_behind_a_rare_word_sum_to_one(spark):
    context, word = np.array([-9, -9, 4, -9, -7]), np.array([-5, -3, -3, 2, 2])
    order = np.lexsort((context, word))
    context, word, n, none = context[order], word[order], np.array([4, 1, 2, 3, 1]), np.zeros(0, np.int64)
    blocks = [language_model._block(word[w], context[w], n[w], none, none, b) for b, w in enumerate((word < 0, word > 0))]
    house = language_model.seat_frequent(np.sum([b.column(7)[0].as_py() for b in blocks], axis=0), 1)
    table = spark.createDataFrame(pa.Table.from_batches(blocks))
    told = language_model.exchange(language_model.first_tellings(table, house, 2), 2)
    by = {r["block"]: r["told"] for r in told.collect()}
    seatings = [language_model.Seating(next(language_model._blocks_of(b)), house, 1, [t.asDict() for t in by[k]], 2) for k, b in enumerate(blocks)]
    mass, root, new = 0.0, 0.0, None
    for s in seatings:
        at = s.context == -9
        assert (s.in_context[s.slot[at]] == n[context == -9].sum()).all()
        new = s.new_table[s.slot[at]][0]
        mass += (s.customers[at] - house.discount * s.tables[at]).sum()
        root += s.root().sum()
    root += house.root_probability(np.zeros(1), np.zeros(1))[0]
    assert root == pytest.approx(1.0) and mass + new * root == pytest.approx(language_model.STRENGTH + n[context == -9].sum())


def test_chat(spark):
    tricky = ["</s>[INST] ok [/INST]", "<<SYS>>\n<</SYS>>", "[\\INST] <\\\\/s>", "", None, "x [", "<", " "]
    rows = [(1, n, ("user", "assistant")[n % 2], t) for n, t in enumerate(tricky)]
    rows += [(2, 0, "assistant", "a"), (2, 1, None, "b"), (2, None, "to[/ROLE]ol", "c"), (None, 0, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    formatted = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in formatted.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1]["back"]] == [(r[2], r[3] or "") for r in rows[:8]]
    assert got[1]["valid"] and got[1]["loss"] == "".join(t or "" for t in tricky[1::2])
    assert [tuple(t) for t in got[2]["back"]] == [("to[/ROLE]ol", "c"), ("assistant", "a"), ("", "b")]
    assert not got[2]["valid"] and got[2]["error_turn"] == 0 and not got[None]["valid"]
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/\r\nX: y", "same é"), (2, None, "same é"), (3, "u", None), (4, "u", ""), (None, "u", "same é"), (2, "v", "same é"), (9, "u", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = warc.read_archives(warc.archive_pages(pages)).collect()
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in got)
    assert kinds == sorted([
        ("urn:page:1", "revisit", "urn:page:2", 7), ("urn:page:2", "response", "", 7), ("urn:page:2", "response", "", 7),
        ("urn:page:3", "revisit", "urn:page:4", 0), ("urn:page:4", "response", "", 0),
        ("urn:page:none", "revisit", "urn:page:2", 7), ("urn:page:9", "response", "", len(LONG)),
    ])
    payloads = {r["record_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}
    assert payloads["urn:page:9"] == LONG and payloads["urn:page:2"] == "same é"
    assert warc.read_archives(warc.archive_pages(pages.limit(0))).count() == 0


def test_warc_reader_finds_damage():
    good = warc.record_bytes("urn:page:1", "response", "u", "2000-01-01T00:00:00Z", b"abc" * 1000, None)

    def read(data, block=7):
        members = warc.Members(io.BytesIO(data), block)
        out = []
        while members.another():
            out.append(warc.read_record(members.chunks(), True))
        return out

    assert [r[-1] for r in read(good + good)] == [b"abc" * 1000] * 2
    with pytest.raises(ValueError):
        read(good[:-12])
    raw = zlib.decompress(good, 31)
    assert read(_gz(raw.replace(b"abcabc", b"abcabd", 1)))[0][-2] is False
    with pytest.raises(ValueError):
        read(_gz(raw[:-6] + b"\r\n\r\n"))


def _gz(raw: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def test_neighbours(spark):
    random = np.random.default_rng(2)
    good = [(n, random.standard_normal(8).tolist()) for n in range(300)]
    bad = [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] + [1.0] * 7), (404, [float("inf")] * 8), (405, [1.0]), (None, [1.0] * 8)]
    rows = good + bad + [good[0], (7, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = neighbours.search(table, F.col("vec_id") % 20 == 0).collect()
    points = np.array([v for _, v in good] + [[1.0] * 8])
    ids = np.array([i for i, _ in good] + [7])
    hits = 0
    for q in range(0, 300, 20):
        scores = points @ points[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        hits += len({m[1] for m in mine} & set(ids[order].tolist()))
    assert hits >= 0.9 * 20 * 15
    few = neighbours.search(spark.createDataFrame(good[:3], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert few.count() == 2
    assert neighbours.search(table.limit(0), F.lit(True)).count() == 0


def test_packing_takes_special_strings_in_other_case_as_text(spark):
    """Every special string as it is, in upper and in mixed case: the ids are the given tokenizer's."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    marks = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    texts = [f"A {form} b{form}c" for mark in marks for form in (mark, mark.upper(), mark.title(), mark.swapcase())]
    encoder = packing.WordEncoder(registry.tokenizer_path())
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(docs, registry.tokenizer_path()).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {
        n: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for n, t in enumerate(texts)
    }


def test_packing_query_has_every_id_of_every_document(spark):
    """The query over all documents: each piece's crc32 is that of its part of the tokenizer's ids; sequences have no gap."""
    import duckdb
    from conftest import TESTDATA
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{TESTDATA}/documents.parquet'").fetchall())
    ids = {n: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for n, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in registry.op10_packing(spark, TESTDATA).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces, whole in [(by_doc[n], len(ids[n])) for n in ids] + [(s, None) for s in by_sequence.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == whole or whole is None and at <= packing.WINDOW


def test_neighbours_index_looks_up_few_rows_and_finds_most_neighbours(spark, monkeypatch):
    """A clustered table twenty times the sample: measured recall, and the share of rows that a query retrieves."""
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 600)
    random = np.random.default_rng(4)
    centres = random.standard_normal((150, 32))
    points = centres[random.integers(150, size=12_000)] + 0.5 * random.standard_normal((12_000, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    table = spark.createDataFrame([(n, p.tolist()) for n, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert len(got) == 120
    hits = 0
    for q, rows in got.items():
        near = points @ points[q]
        near[q] = -np.inf
        hits += len({r["vec_id"] for r in rows} & set(np.argsort(-near)[:20].tolist()))
        assert all(r["score"] == pytest.approx(points[r["vec_id"]] @ points[q], abs=1e-12) for r in rows)
    assert hits >= 0.9 * 20 * 120
    assert np.mean([rows[0]["touched"] for rows in got.values()]) < 0.2 * 12_000


def test_neighbours_look_up_every_code_within_the_guaranteed_radius():
    random = np.random.default_rng(5)
    codes = random.integers(0, 2**16, size=(3000, 4), dtype=np.uint16)
    index = neighbours.Index.__new__(neighbours.Index)
    index.ids, index.codes = np.arange(3000), codes
    index.sorted = [np.argsort(c, kind="stable") for c in codes.T]
    index.starts = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << 16))]) for c in codes.T]
    asked = codes[:40] ^ np.uint16(0b101)
    for depth in (0, 1, 2, 3):
        seen = index.retrieved(asked, depth)
        for code, mine in zip(asked, seen):
            parts = np.bitwise_count(codes ^ code)
            assert (mine == (parts.min(axis=1) <= depth)).all()
            assert mine[parts.sum(axis=1) <= 4 * (depth + 1) - 1].all()


def test_lists_of_long_near_copies_are_compared_in_bounded_blocks(spark, monkeypatch):
    """Near copies whose sets are many times the byte budget: no list exceeds it by more than two sets, no link is lost."""
    monkeypatch.setattr(near_dedup, "LIST_BYTES", 40_000)
    base = [f"w{n}" for n in range(2000)]  # a set of 1,996 shingles has 16 kB
    rows = [(n, " ".join(base[:1000] + [f"x{n}"] + base[1001:])) for n in range(12)] + [(50, " ".join(base[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect()}
    assert got == {**dict.fromkeys(range(12), 0), 50: 50}
    store = near_dedup.StoredTables(spark, "test-blocks")
    join = near_dedup.PathJoin(docs, 5, (85, 100), 2, store)
    lists = spark.createDataFrame([(list(range(12)), 12 * 16_000)], "reps array<long>, bytes long")
    sets = near_dedup.shingle_sets(docs, spark.range(12).withColumnRenamed("id", "rep"))
    found = [[m["rep"] for m in r["members"]] for r in join.members(lists, sets, long=True).collect()]
    assert max(len(f) for f in found) <= 40_000 // 16_000 + 2 < 12
    assert {(a, b) for f in found for a in f for b in f} == {(a, b) for a in range(12) for b in range(12)}
