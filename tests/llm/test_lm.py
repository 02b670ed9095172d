import math
from collections import Counter

import numpy as np
import pytest

from lumora.llm import lm, mixer, spelling, words
from tests.llm.test_first_operators import ODD, odd


def plain(rows):
    tokens = {k: (t or "").encode().lower().split() + [b"\n"] for k, t in rows}
    held = {k: k is not None and lm.crc_fold(k) == 2 for k in tokens}
    seen = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(seen.values()), len(seen)
    base = {k: sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws) for k, ws in tokens.items()}
    return tokens, held, seen, n, base


@pytest.mark.parametrize("hot", [100_000, 50])
def test_base_counts_and_costs(spark, sf, hot):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    tokens, held, seen, n, base = plain(rows)
    got = {r["id"]: r for r in lm.score_documents(docs, table_bits=16, spell_bits=16, hot=hot).collect()}
    assert sorted(got) == sorted(tokens)
    for k, ws in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[k], len(ws), n)
        assert r["n_known"] == sum(seen[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(base[k])
        assert r["score"] < 0
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / len(dict(rows)[k].encode()))
    seen = test_base_counts_and_costs.__dict__.setdefault("seen", got)
    assert all(r["score"] == pytest.approx(got[k]["score"], rel=1e-6) for k, r in seen.items())


def test_held_out_scores_beat_the_base(spark, sf):
    """On sf0.01 the model gives the held-out texts, taken together, a higher probability than the base; most training texts too."""
    docs = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    rows = lm.score_documents(docs).collect()
    model, base = (sum(r[c] for r in rows if r["held_out"]) for c in ("score", "base_score"))
    assert model > base
    trained = [r for r in rows if not r["held_out"]]
    assert sum(r["score"] > r["base_score"] for r in trained) > 0.95 * len(trained)


def plain_huffman(counts):
    import heapq

    heap = [(c, k, (k,)) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    size, n = [0] * len(counts), len(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for k in x + y:
            size[k] += 1
        heapq.heappush(heap, (a + b, n, x + y))
        n += 1
    return size


def test_the_code_is_prefix_free_and_short():
    counts = np.random.default_rng(1).integers(1, 1000, 300)
    offsets, nodes, bits = mixer.huffman(counts)
    codes = {"".join(map(str, bits[a:b])) for a, b in zip(offsets, offsets[1:])}
    assert len(codes) == 300 and not any(x != y and y.startswith(x) for x in codes for y in codes)
    assert np.diff(offsets).dot(counts) == np.dot(plain_huffman(counts.tolist()), counts)
    below = {}
    for a, b in zip(offsets, offsets[1:]):
        for k in range(a, b):
            assert below.setdefault((int(nodes[k]), int(bits[k])), int(nodes[k + 1]) if k + 1 < b else -a - 1) in (int(nodes[k + 1]) if k + 1 < b else -a - 1,)


def test_symbols_have_probabilities_that_sum_to_one():
    rng = np.random.default_rng(2)
    code = words.WordCode(np.array([5, 9, 7, 4, *rng.integers(1, 50, 40)]), 2, 12)
    texts = [rng.integers(0, code.symbols, 30) for _ in range(20)]
    flat, lengths = np.concatenate(texts), [30] * 20
    found, pairs = code.contexts(flat, lengths), words.Pairs(code)
    for part in (slice(0, 210), slice(210, None)):
        pairs.add(flat[part], found[0][part], found[1][part])
    tables = pairs.tables()
    _, bit, places = code.bits_of(flat, *found)
    for k, table in enumerate(tables):
        want = np.zeros(len(table), int)
        np.add.at(want, 2 * places[k] + bit, 1)
        assert (table == want).all()
    model = words.WordModel(code, [mixer.coded(t[0::2].astype(float)).astype(np.uint16) << 8 | mixer.coded(t[1::2].astype(float)) for t in tables])
    model.mixer.begin()
    model.learn(flat, found)
    for text in texts[:3]:
        ways = [np.append(text[:9], s) for s in range(code.symbols)]
        each = model.log2(np.concatenate(ways), code.contexts(np.concatenate(ways), [10] * len(ways)))
        assert np.exp2(each.reshape(-1, 10)[:, 9]).sum() == pytest.approx(1, rel=1e-4)


def test_pairs_count_beyond_16_bits():
    code = words.WordCode(np.array([5, 9, 7, 4]), 1, 8)
    pairs, n = words.Pairs(code), 200_000
    flat = np.full(n, 3)
    pairs.add(flat, np.ones(n, np.int64), np.full(n, 2))
    assert all(t.sum() == n * code.size[3] for t in pairs.tables())


def test_contexts_by_a_plain_loop():
    rng = np.random.default_rng(3)
    code = words.WordCode(np.ones(60), 3, 10)
    texts = [rng.integers(0, 60, n) for n in (1, 40, 7)]
    flat = np.concatenate(texts)
    two, prev = code.contexts(flat, [len(t) for t in texts])
    at = 0
    for text in texts:
        seen = [0, 0]
        last = 0
        for s in text:
            assert (two[at], prev[at]) == (seen[0] * (words.FREQUENT + 1) + seen[1], last)
            if code.first_word <= s < code.first_word + words.FREQUENT:
                seen = [seen[1], int(s) - code.first_word + 1]
            last, at = int(s), at + 1


def speller(given, counts, bits):
    e = spelling.events_of(given, counts)
    tables = [np.zeros(2 << bits, "f4") for _ in range(spelling.HASHED)]
    spelling.count_into(tables, e, bits)
    out = spelling.Speller(bits, np.stack([mixer.coded(t[0::2]) for t in tables]), np.stack([mixer.coded(t[1::2]) for t in tables]))
    out.mixer.begin()
    out.learn(e)
    return out, e


def test_probabilities_of_all_next_bytes_sum_to_one():
    given = sorted(b"ab" + bytes([c]) for c in range(33, 256))
    m, e = speller(given, np.arange(len(given), dtype=float), 16)
    at = int(np.flatnonzero(e.place == 2)[0])
    every = spelling.Events(np.tile(e.slots[:, at : at + 1], (1, 256)), np.arange(256), np.zeros(256), np.full(256, 2), np.full((8, 2, 256), -1, "f4"))
    assert np.exp2(m.log2(every)).sum() == pytest.approx(1, rel=1e-4)


def test_whole_word_counts_are_exact():
    given = sorted({b"thanedble", b"thanes", b"than", b"thaned", b"order", b"orders", b"rare"})
    counts = np.array([9.0, 3, 50, 7, 20, 5, 1])
    m, e = speller(given, counts, 14)
    for rows, at in e.chains:
        for w, i in zip(rows, at):
            j = int(e.place[i])
            same = [(x + b" ", c) for x, c in zip(given, counts) if (x + b" ")[:j] == (given[w] + b" ")[:j]]
            assert e.weight[i] == sum(c for x, c in same if x[j] == (given[w] + b" ")[j])
            if j >= spelling.STEM:
                assert e.exact[0, 0, i] == sum(c for x, c in same if x[j] < 128)
    whole, rest = m.words(given, counts)
    assert dict(zip(given, whole))[b"than"] > dict(zip(given, whole))[b"thanes"] and (rest < 0).all() and (whole <= rest).all()


def test_stretches_cover_everything_and_hold_all_siblings():
    import pandas as pd

    given = sorted({b"%c%05d" % (97 + k % 3, k * 7919 % 50_000) for k in range(9000)} | {b"www." + b"%06d" % (k * 31337 % 999_983) for k in range(5000)})
    frame = pd.DataFrame({"word": given, "n": range(len(given))})
    out = list(spelling.stretches(iter([frame[:4000], frame[4000:]]), most=1000))
    assert [w for ws, _, _ in out for w in ws] == given and len(out) > 1
    home = {}
    for k, (ws, _, stem) in enumerate(out):
        for w in ws:
            for j in range(stem, len(w) + 1):
                assert home.setdefault(w[:j], k) == k


def test_odd_rows(spark):
    rows = lm.score_documents(odd(spark), table_bits=12, spell_bits=12).collect()
    assert len(rows) == len(ODD)
    same = {r["score"] for r in rows if r["n_tokens"] == 1}
    assert len(same) == 1 and len([r for r in rows if r["n_tokens"] == 1]) == 3
    assert [r["held_out"] for r in rows if r["id"] is None] == [False]
    assert lm.score_documents(odd(spark).limit(0), table_bits=12, spell_bits=12).count() == 0


def test_weights_learn_from_every_text_and_event(spark):
    import numpy as np

    from lumora.llm import lm, spelling
    from lumora.llm.words import WordCode, WordModel

    code = WordCode(np.array([1, 2, 40, 30]), 0, 10)
    names = lm.Symbols({lm.END: 0, b"a": code.first_word, b"b": code.first_word + 1}, {})
    for k in range(3):
        model = lm.fit_words(spark.createDataFrame([("a b a " * (9 + k),)], "text string").coalesce(1), code, names, 2)
        fresh = WordModel(code, model.tables).mixer
        fresh.begin()
        assert model.mixer.state() != fresh.state()
    words = sorted({f"w{k}".encode() for k in range(50)})
    events = spelling.events_of(words, np.ones(len(words)), spelling.STEM)
    table = np.zeros((spelling.HASHED, 1 << 10), np.uint8)
    own, seen = spelling.Speller(10, table, table), []
    own.mixer.begin()
    own.mixer.learn = lambda bit, *_: seen.append(len(bit))
    own.learn(events)
    assert sum(seen) == 8 * len(events.byte)


def test_words_are_looked_up_once_for_both_passes(spark, monkeypatch):
    """Counting and learning read one table of symbols, which goes when both are done."""
    code = words.WordCode(np.array([1, 2, 40, 30]), 0, 10)
    names = lm.Symbols({lm.END: 0, b"a": code.first_word, b"b": code.first_word + 1}, {})
    settle, written = lm.settle, []

    def recorded(df):
        out = settle(df)
        written.append((out, out.collect()))
        return out

    monkeypatch.setattr(lm, "settle", recorded)
    lm.fit_words(spark.createDataFrame([("a B zz a",), (None,), ("b",)], "text string").coalesce(1), code, names, 2)
    (table, rows), = written
    a, b = code.first_word, code.first_word + 1
    assert [np.frombuffer(r["symbols"], "<u2").tolist() for r in rows] == [[a, b, words.RARE, a, 0], [0], [b, 0]]
    with pytest.raises(Exception):
        table.collect()


def test_learning_in_single_precision_follows_the_sums_of_all_bits():
    rng = np.random.default_rng(4)
    n, gates = 20_000, 7
    stretch = [rng.normal(size=n).astype("f4") * 3 for _ in range(3)]
    bit, gate, weight = rng.integers(0, 2, n), rng.integers(0, gates - 1, n).astype(np.int32), rng.integers(1, 50, n).astype(float)
    own = mixer.Mixer(gates, [0.5, 0.25, 0.25])
    own.begin()
    was = own.weights.copy()
    odds, _, part = own.refined(own.mixed(stretch, gate), gate)
    assert odds.dtype == part.dtype == np.float32  # doubles here cost as much again
    own.learn(bit, stretch, gate, weight)
    for g in range(gates):
        x = np.stack([s[gate == g].astype(float) for s in stretch], axis=1)
        p = 1 / (1 + np.exp(-np.clip(x @ was[:, g], -mixer.LIMIT, mixer.LIMIT)))
        w, bend = weight[gate == g], np.eye(3) * 200.0
        bend += (x * (p * (1 - p) * w)[:, None]).T @ x
        step = np.linalg.solve(bend, x.T @ ((bit[gate == g] - p) * w))
        assert own.weights[:, g] == pytest.approx(np.clip(was[:, g] + np.clip(step, -0.1, 0.1), -0.5, 1.5), rel=1e-4, abs=1e-5)


def test_scores_are_read_from_the_symbols_that_the_tables_count(spark, monkeypatch):
    """Texts of all rows are split once into symbols; the gates of their bits are places, which no step has to widen."""
    settle, written = lm.settle, []

    def recorded(df):
        out = settle(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(lm, "settle", recorded)
    docs = spark.createDataFrame([(k, f"a b{k % 3} a b{k % 3}") for k in range(40)], "doc_id long, text string").coalesce(2)
    rows = lm.score_documents(docs, table_bits=10, spell_bits=10).collect()
    assert [n for columns, n in written if "symbols" in columns] == [40] and {r["held_out"] for r in rows} == {True, False}
    assert words.LAST[0].dtype == words.OFTEN[1].dtype == np.intp


def test_words_are_split_at_ascii_white_space_only():
    import random

    import pyarrow as pa

    draw = random.Random(1)
    texts = ["".join(draw.choices(" \t\n\x0b\x0c\r\x1c\x85\xa0\x00\u2003aBÀé漢", k=draw.randrange(30))) for _ in range(500)] + [None, "", "  "]
    flat, lengths = lm.split_words(pa.array(texts).slice(3))
    want = [(t or "").encode().lower().split() for t in texts[3:]]
    assert flat.to_pylist() == [w for ws in want for w in ws] and lengths.tolist() == list(map(len, want))
