import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from lumora.llm import packing, tokens
from tests.llm.test_first_operators import ODD, odd

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
TEXTS = [
    "",
    " ",
    "it's we'll 're 'r don't's '' ''s --'ll 123abc ½²³ ªº",
    "é́é İstanbul ΑΣ ΑΣΑ ſ ﬁ",
    "<|endoftext|> a<|startoftext|>b <|x|>",
    "a\xa0\xa0b c\x1cd\x1f\x85e",
    "日本語テキスト です。 नमस्ते",
    "👩‍👩‍👧 🏳️‍🌈",
    "x" * 300 + "!" * 200 + "ab" * 150,
    "\x00\x01 \x7f ß ẞ Ǆ ǅ\ra\x0bc\x0cd\n\n\te",
]


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary(PATH)


def library(vocabulary, texts):
    return [e.ids for e in vocabulary.encoder.encode_batch(texts, add_special_tokens=False)]


def test_prefix_counts_equal_the_library(vocabulary):
    rng = random.Random(0)
    some = ["".join(rng.choice("ab'stre ́éİ<|1½.,\xa0") for _ in range(40)) for _ in range(60)]
    some += ["".join(rng.choice("thanderi") for _ in range(100)) for _ in range(5)]
    counter = tokens.PrefixSteps(vocabulary)
    for text in TEXTS + some:
        want = [len(x) for x in library(vocabulary, [text[:i] for i in range(len(text) + 1)])]
        assert counter.counts(text) == want, text


@pytest.mark.parametrize("letters", ["สวัสดีครับผมชื่อ", "नमस्तेदुनियाकैसे", "e\u0301a\u0300u\u0308n\u0303sl", "<|endoftext|>ab\u0301", "\u1100\u1161\u11a8가a", "e\u0301'\u0308l1½!sİ"])
def test_scripts_of_combining_characters_and_added_tokens(vocabulary, letters):
    """Random runs without white space, long enough for pieces that are stepped along: every prefix equals the library's count."""
    rng, counter = random.Random(len(letters)), tokens.PrefixSteps(vocabulary)
    for n in (7, 60, 300):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert counter.counts(text) == [len(x) for x in library(vocabulary, [text[:i] for i in range(n + 1)])], text


@pytest.mark.parametrize(
    "text",
    ["a<|endoftext|>\u0301b<|endoftext|><|startoftext|>e\u0301", "x" * 100 + "e\u0301" * 50, "<|endoftext|" * 9, "'" * 80 + "e\u0301", "a" * 70 + "'e\u0301", "İ" * 90 + "\u0307"],
)
def test_turns_in_long_pieces(vocabulary, text):
    assert tokens.PrefixSteps(vocabulary).counts(text) == [len(x) for x in library(vocabulary, [text[:i] for i in range(len(text) + 1)])]


@pytest.mark.parametrize("text", ["สวัสดีครับ" * 10_000, "नमस्तेदुनिया" * 8_000, "e\u0301" * 50_000, "<|" + "ab" * 50_000, "<|endoftext|>" * 8_000])
def test_a_hundred_thousand_characters_in_one_run(vocabulary, text):
    """Seconds, where asking for each beginning would take hours; the last count is the library's."""
    counts = tokens.PrefixSteps(vocabulary).counts(text)
    assert len(counts) == len(text) + 1 and counts[-1] == len(library(vocabulary, [text])[0])


def test_a_full_cache_changes_nothing(vocabulary):
    small = tokens.PrefixSteps(vocabulary, keep=3)
    ids = tokens.ChunkIds(vocabulary, keep=2)
    for text in TEXTS * 2:
        assert small.counts(text)[-1] == len(library(vocabulary, [text])[0])
        assert next(ids.batches([text]))[0] == np.array(library(vocabulary, [text])[0], "<u4").tobytes()


def test_the_pipeline_remembers_fewer_words(spark, monkeypatch):
    """Its workers stand beside executors whose heap is full: bounded by what its stage asks for, with the same pieces."""
    import corpus_pipeline

    rows = [(k, " ".join(f"w{k}x{i}" for i in range(50))) for k in range(40)]
    small = tokens.held(tokens.ChunkIds, PATH, 100)
    for _, text in rows:
        next(small.batches([text]))
    assert len(small.known) <= 110 and len(small.before) <= 110 and tokens.held(tokens.ChunkIds, PATH).keep == 400_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = [sorted(packing.token_pieces(docs, PATH, 64, 1, keep=k).collect()) for k in (None, 20)]
    assert pieces[0] == pieces[1] and len(pieces[0]) > 40
    asked, best_fit = [], packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda *a, **k: asked.append(k) or best_fit(*a, **k))
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == 40 and asked[0]["keep"] <= 100_000


def test_wide_steps_are_stored_too():
    steps = np.array([1, 300, -299, 0], "<i2").tobytes()
    assert tokens.read_table(tokens.prefix_table(steps)).tolist() == [0, 1, 301, 2, 2]


def test_every_prefix_of_the_query(spark, sf, vocabulary):
    """The registered query's stored tables hold the library's count of every prefix, and its answers come from them."""
    from lumora.llm.queries import op7_token_counts

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rng = random.Random(3)
    few = set(rng.sample(sorted(k for k in texts if len(texts[k]) < 3000), 12))
    for r in op7_token_counts(spark, sf).collect():
        counts, text = tokens.read_table(r["prefix_table"]), texts[r["doc_id"]]
        assert len(counts) == len(text) + 1 and counts[-1] == r["n_tokens"] and r["over_limit"] == (r["n_tokens"] > 2048)
        assert r["chars_in_limit"] == max(i for i, n in enumerate(counts) if n <= 2048)
        if r["doc_id"] in few:
            assert counts.tolist() == [len(x) for x in library(vocabulary, [text[:i] for i in range(len(text) + 1)])]


def test_prefix_tables_answer_questions(spark, sf, vocabulary):
    F = tokens.F
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    docs = docs.unionByName(more).withColumns({"n_tokens": F.lit("old"), "prefix_table": F.lit(1), "id": F.lit(2), "t": F.lit(3)})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = tokens.prefix_tables(docs, PATH)
    out = out.withColumn("half", tokens.tokens_at(F.col("prefix_table"), F.lit(10)))
    out = out.withColumn("cut", tokens.longest_within(F.col("prefix_table"), F.lit(7)))
    keys = sorted(texts)
    true = dict(zip(keys, map(len, library(vocabulary, [texts[k] for k in keys]))))
    for r in out.collect():
        text = texts[r["id"]]
        assert r["n_tokens"] == true[r["id"]] and r["n_bytes"] == len(text.encode())
        assert r["half"] == (len(library(vocabulary, [text[:10]])[0]) if len(text) >= 10 else None)
        assert len(library(vocabulary, [text[: r["cut"]]])[0]) <= 7
        if r["cut"] < len(text):
            assert len(library(vocabulary, [text[: r["cut"] + 1]])[0]) > 7


def test_prefix_tables_odd_rows(spark, vocabulary):
    rows = tokens.prefix_tables(odd(spark), PATH).collect()
    assert len(rows) == len(ODD)
    assert {r["id"]: r["n_tokens"] for r in rows}[4] == 30_000
    assert tokens.prefix_tables(odd(spark).limit(0), PATH).count() == 0


def test_open_bins_by_a_plain_best_fit():
    rng = random.Random(1)
    bins, want, closed = packing.OpenBins(50, 4), [], []
    plain: list[list] = []
    for n in range(500):
        size = rng.randint(1, 50)
        closed += [sorted(i for i, _ in items) for _, items in bins.add(size, n)]
        free = lambda b: 50 - sum(s for _, s in b)
        fits = [b for b in plain if free(b) >= size]
        if fits:
            best = min(fits, key=free)
        else:
            best = []
            plain.append(best)
        best.append((n, size))
        if free(best) == 0:
            plain.remove(best)
            want.append(sorted(i for i, _ in best))
        elif len(plain) > 4:
            full = min(plain, key=free)
            plain.remove(full)
            want.append(sorted(i for i, _ in full))
    # bins of equal free space are interchangeable, so sizes are compared
    assert [len(x) for x in closed][:40] == [len(x) for x in want][:40]
    assert abs(len(closed) - len(want)) <= 2


@pytest.mark.parametrize("parts", [1, 40])
def test_packing_is_lossless_and_tight(spark, sf, vocabulary, parts):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = packing.best_fit(docs, PATH, parts=parts).toPandas()
    keys = sorted(texts)
    ids = {k: np.array([*x, 1], "<u4") for k, x in zip(keys, library(vocabulary, [texts[k] for k in keys]))}
    assert sorted(out.groupby("id").size().items()) == [(k, 2 * -(-len(ids[k]) // 4096)) for k in keys]
    for r in out.itertuples():
        part = ids[r.id][r.start : r.start + 4096]
        assert (r.start, r.length, r.ids_crc32) == (r.piece * 4096, len(part), zlib.crc32(part.tobytes()))
    used = 0
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
        used += 1
    least = -(-sum(2 * len(x) for x in ids.values()) // 4096)
    assert used <= 1.03 * least + 1


def test_packing_odd_rows(spark):
    got = packing.best_fit(odd(spark), PATH, parts=3).toPandas()
    sizes = defaultdict(list)
    for r in got.itertuples():
        sizes[None if pd.isna(r.id) else r.id].append(r.length)
    assert sizes[2] == sizes[3] == sizes[5] == [1] and len(sizes[None]) == 1
    assert sum(sizes[4]) == 2 * 30_001
    assert packing.best_fit(odd(spark).limit(0), PATH, parts=3).count() == 0


def test_pieces_that_do_not_combine_never_meet_in_one_task(spark, monkeypatch):
    """Documents of about 2500 tokens: each takes a sequence, and the rounds end before one partition holds all rows."""
    text = " ".join(["the"] * 2500)
    docs = spark.createDataFrame([(k, text) for k in range(600)], "doc_id long, text string")
    passes, dealt = [], packing._shuffled
    monkeypatch.setattr(packing, "_shuffled", lambda pieces, parts: passes.append((pieces.count(), parts)) or dealt(pieces, parts))
    out = packing.best_fit(docs, PATH, parts=64)
    assert out.select("sequence_id").distinct().count() == 600
    assert all(parts > 1 for rows, parts in passes if rows == 600), passes


def test_chunk_caches_stay_small(vocabulary):
    ids = tokens.ChunkIds(vocabulary)
    for at in range(0, 900_000, 50_000):
        for _ in ids.batches([" ".join(f"a{k:x}" for k in range(at, at + 50_000))]):
            pass
    assert len(ids.known) + len(ids.before) + len(ids.pieces) < 500_000
