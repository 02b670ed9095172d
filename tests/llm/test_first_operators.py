import zlib
from collections import defaultdict

import numpy as np
import pytest

from lumora.llm import media, mixing, quality, shards, simhash, url_trust

ODD = [
    (1, "a b c d", "x"),
    (2, None, "x"),
    (3, "", None),
    (None, "a b c d", "y"),
    (4, "word " * 30_000, "y"),
    (4, "word " * 30_000, "y"),
    (5, " \t\n ", "x"),
    (6, "é ü\u3000ß A# $b", "z"),
]
SCHEMA = "doc_id long, text string, source string"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def grouped(ids, link):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in link:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def naive_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] * bool(now)
            now = ""
        else:
            now += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("long_list", [128, 1])
def test_simhash_components_equal_brute_force(spark, sf, long_list):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs, long_list=long_list).collect()}
    prints = {r["doc_id"]: naive_fingerprint(r["text"]) for r in docs.collect()}
    ids = sorted(prints)
    want = grouped(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert got == {i: (prints[i], want[i]) for i in ids}


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("long_list", [128, 2])
def test_links_of_crowded_fingerprints(spark, bits, long_list):
    rng = np.random.default_rng(bits)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 6)]
    prints = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for k in rng.integers(0, 63, rng.integers(1, 5)):
                x ^= 1 << int(k)
            prints.add(x)
    from lumora.operators.components import components

    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), bits, long_list)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    ids = sorted(prints)
    want = grouped(ids, [(a, b) for a in ids for b in ids if a < b and ((a ^ b) % (1 << 64)).bit_count() <= bits])
    assert {i: got.get(i, i) for i in ids} == want


def test_simhash_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {2}
    assert [r["component_id"] for r in rows if r["id"] is None] == [1]
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_shards_are_near_equal_stretches(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("source", "size")
    rows = shards.shard_by_bytes(docs, 24, ranges=16, per_range=8).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["id"] for r in rows) == sorted(texts)
    sums, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        data = texts[r["id"]].encode()
        assert (r["size"], r["crc"]) == (len(data) + 8, zlib.crc32(data))
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sums.values()) / 24
    most = max(r["size"] for r in rows)
    assert sorted(sums) == list(range(24))
    assert all(abs(x - mean) <= most + 0.05 * mean for x in sums.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_a_hot_group_is_cut_and_small_ones_stay_whole(spark):
    rows = [(i, "hot" * 9) for i in range(900)] + [(1000 + i, f"text {i // 2} " + "x" * 10) for i in range(1800)]
    out = shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 6, ranges=24).collect()
    per, of = defaultdict(int), defaultdict(set)
    for r in out:
        per[r["shard"]] += r["size"]
        of[r["key"]].add(r["shard"])
    mean = sum(per.values()) / 6
    assert len(per) == 6 and all(abs(x - mean) <= 0.05 * mean + 40 for x in per.values())
    assert sorted(len(x) for x in of.values())[-2] == 1


def test_overfull_ranges_are_subdivided(spark):
    """One splitter for each of 40 ranges, from samples of one record a range: ranges come out uneven, and are cut until none is overfull."""
    F = quality.F
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), F.when(F.col("id") % 10 == 0, 400).otherwise(5)).alias("text"))
    items = df.select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("crc"), F.md5("text").alias("key"), F.lit(1).cast("long").alias("n"))
    first = shards._ranged(items, shards._splitters(items, 40, 1)).groupBy("range").agg(F.sum("size").alias("b")).collect()
    _, sums = shards._balanced(items, 40, 1)
    mean = sum(r["b"] for r in first) / 40
    rows = sums.collect()
    assert max(r["b"] for r in first) > 2 * mean >= max(r["b"] for r in rows) and sum(r["c"] for r in rows) == 3000
    for ranges in (2, 40):
        out = shards.shard_by_bytes(df, 7, ranges=ranges, per_range=1).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("s")).collect()
        assert len(out) == 7 and max(r["b"] for r in out) - min(r["b"] for r in out) < 2 * 2000 and all(r["s"] == r["n"] - 1 for r in out)


def test_shards_odd_rows(spark):
    rows = shards.shard_by_bytes(odd(spark), 3).collect()
    assert len(rows) == len(ODD)
    assert sorted(r["size"] for r in rows)[:2] == [8, 8]
    assert shards.shard_by_bytes(odd(spark).limit(0), 3).count() == 0
    same = spark.createDataFrame([(7, "t")] * 25_000, "doc_id long, text string")
    got = shards.shard_by_bytes(same, 4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [6250] * 4


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 9000])
def test_png_round_trip(size):
    data = bytes(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8))
    payload = media.pad(data, 576)
    assert len(payload) % 576 == 0 and payload[: len(data)] == data and len(payload) > 0
    blob = media.encode_png(payload, 192)
    assert media.decode_png(blob).tobytes() == payload
    with pytest.raises(ValueError):
        media.decode_png(blob[:40] + bytes([blob[40] ^ 1]) + blob[41:])


def test_png_unfilter_matches_a_plain_loop():
    rng = np.random.default_rng(3)
    kinds, raw = rng.integers(0, 5, 40).astype(np.uint8), rng.integers(0, 256, (40, 17), dtype=np.uint8)
    want = np.zeros((40, 17), int)
    for y in range(40):
        for x in range(17):
            a = want[y, x - 1] if x else 0
            b = want[y - 1, x] if y else 0
            c = want[y - 1, x - 1] if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            want[y, x] = (int(raw[y, x]) + (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256
    assert (media._unfilter(kinds, raw) == want).all()


def test_media_columns(spark):
    rows = media.media_columns(odd(spark)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(t for i, t, _ in ODD if i == r["id"]) or ""
        assert bytes(r["payload"]) == media.pad(text.encode(), 576) and r["n_bytes"] == len(text.encode())
        assert len(r["feature"]) == 8
    near = np.kron(np.random.default_rng(1).integers(0, 200, (6, 12)), np.ones((5, 16))).astype(np.uint8)
    other = near.copy()
    other[3, 5] += 9
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    assert far(media.cosine_hash(near), media.cosine_hash(other)) <= 6


def test_repeat_windows_by_brute_force():
    rng = np.random.default_rng(0)
    for n in [*range(40), 200]:
        words = [b"ab"[int(k) : int(k) + 1] for k in rng.integers(0, 2, n)]
        seen = defaultdict(list)
        for i in range(n - 7):
            seen[tuple(words[i : i + 8])].append(i)
        cover = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
        assert quality._repeats(words, 8) == len(cover)


def test_quality_ledger(spark, sf):
    rows = {r["id"]: r for r in quality.ledger(odd(spark)).collect()}
    assert rows[2]["n_words"] == 0 and rows[2]["failed"] & 1
    assert rows[4]["n_repeat_words"] == 30_000 and rows[4]["failed"] & 2
    assert rows[6]["word_chars"] == 8 and rows[6]["n_symbols"] == 2
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    book = quality.ledger(docs, keep=True)
    assert set(docs.columns) <= set(book.columns)
    masks = [r["failed"] & quality.mask(quality.POLICIES["v3"]) for r in book.collect()]
    for r in quality.ablations(book, "v3").collect():
        bit = quality.mask((r["rule"],))
        assert r["n_failed"] == sum(m & bit > 0 for m in masks)
        assert r["n_only"] == sum(m == bit for m in masks)
        assert r["n_kept_without"] == sum(m & ~bit == 0 for m in masks)


def test_quality_keeps_good_documents(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    got = quality.ledger(docs, keep=True).join(labels, "doc_id").withColumn("ok", quality.verdict(quality.F.col("failed"), "v2"))
    n = {(r["quality"], r["ok"]): r["count"] for r in got.where("n_words >= 20").groupBy("quality", "ok").count().collect()}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))


def test_poisson_counts(spark):
    rates = [0.0, 0.3, 1.0, 4.5, 60.0, 1200.0]
    ids = spark.range(400).crossJoin(spark.createDataFrame([(r,) for r in rates], "rate double"))
    F = quality.F
    got = ids.withColumn("n", mixing.poisson_count(F.col("rate"), 5, F.col("id")))
    for r in got.groupBy("rate").agg(F.avg("n").alias("m"), F.variance("n").alias("v")).collect():
        assert abs(r["m"] - r["rate"]) <= 5 * (r["rate"] / 400) ** 0.5
        assert r["rate"] == 0 or 0.6 < r["v"] / r["rate"] < 1.5
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(5), F.lit(1), F.col("id")), 11).cast("double") + 0.5) / float(1 << 53)
    for r in got.where("rate < 500").withColumn("u", u).collect():
        assert r["n"] == mixing.exact_poisson(r["u"], r["rate"])


def test_mix_reaches_the_targets(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    got = mixing.mix(docs, weights={"src0": 3.0, "src1": 1.0}, volume=0.5)
    assert got.columns == [*docs.columns, "copy", "mix_key"]
    by = {r["source"]: r["b"] for r in got.groupBy("source").agg(quality.F.sum(quality.F.octet_length("text")).alias("b")).collect()}
    assert set(by) == {"src0", "src1"}
    sizes = defaultdict(list)
    for r in docs.select("source", quality.F.octet_length("text").alias("b")).collect():
        sizes[r["source"]].append(r["b"])
    total = sum(map(sum, sizes.values()))
    for source, share in (("src0", 0.75), ("src1", 0.25)):  # within three standard deviations of a Poisson sum
        target = share * 0.5 * total
        rate = target / sum(sizes[source])
        assert abs(by[source] - target) < 3 * (rate * sum(b * b for b in sizes[source])) ** 0.5
    keys = [r["mix_key"] for r in got.select("mix_key").collect()]
    assert keys == sorted(keys)
    rows = mixing.mix(odd(spark), power=1.0).collect()
    assert all(r["copy"] >= 0 for r in rows) and mixing.mix(odd(spark).limit(0)).count() == 0


def test_mix_counts_by_plain_arithmetic(spark, sf):
    """Every row's repeats and place in the order, from the rates of its source and the hashes, computed in plain Python."""
    F = quality.F
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size, want = defaultdict(int), {}
    rows = docs.select("*", (F.shiftrightunsigned(F.xxhash64(F.lit(17), F.lit(1), "doc_id", F.lit(0).cast("long")), 11)).alias("u")).collect()
    for r in rows:
        size[r["source"]] += len(r["text"].encode())
    root = {s: b**0.5 for s, b in size.items()}
    for r in rows:
        s = r["source"]
        rate = root[s] / sum(root.values()) * sum(size.values()) / size[s]
        n = mixing.exact_poisson((r["u"] + 0.5) / (1 << 53), rate)
        if n:
            want[r["doc_id"]] = n
    got = mixing.mix(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == want


@pytest.mark.parametrize("few", [10_000, 10])
def test_repeated_rows_draw_alike_in_any_layout(spark, tmp_path, monkeypatch, few):
    """The same rows in one file, in eight and in another order: the same multiset of rows, copies and places."""
    monkeypatch.setattr(mixing, "FEW", few)
    rows = [(k % 200, f"text {k % 400}", "ab"[k % 2], None) for k in range(1000)] + [(None, "lost", None, "en"), (None, None, "lost", "en")] * 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    docs.orderBy(quality.F.rand(3)).repartition(8).write.parquet(f"{tmp_path}/eight")
    one, eight = (sorted(map(repr, mixing.mix(spark.read.parquet(f"{tmp_path}/{x}")).collect())) for x in ("one", "eight"))
    assert one == eight and len(set(one)) == len(one)


def test_rows_without_ids_and_repeated_rows_draw_for_themselves(spark):
    F = quality.F
    rows = [(None, "same text", "a", 5, 6, 7)] * 4000 + [(None, f"text {k}", "a", 5, 6, 7) for k in range(2000)] + [(9, "x", "a", 5, 6, 7)] * 1000
    names = "doc_id long, text string, source string, __n int, rate int, row int"
    got = mixing.mix(spark.createDataFrame(rows, names), power=1.0).withColumn("kind", F.when(F.col("text").startswith("text"), "other").otherwise(F.col("text")))
    n = {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()}
    assert abs(n["same text"] - 4000) < 300 and abs(n["other"] - 2000) < 200 and abs(n["x"] - 1000) < 150
    assert got.select("__n", "rate", "row").distinct().collect() == [(5, 6, 7)]
    assert got.select("mix_key").distinct().count() == got.count()


def test_url_parts_and_rules(spark):
    F = quality.F
    rows = [
        (1, "HTTP://A.Example.COM/en/7?x#y", None),
        (2, None, "<a href='http://b.example.net/'>"),
        (3, "nothing", ""),
        (4, "x://net/de/", ""),
        (5, "x://example.net?/de/8", ""),
        (6, "x://sub.example.net/de/8#", ""),
        (7, "x://myexample.net/de/8", ""),
    ]
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block"}
    got = {r["id"]: r for r in url_trust.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert [got[k]["host"] for k in (2, 3, 4, 5)] == ["", "", "net", "example.net"]
    assert [got[k]["rule"] for k in (2, 3, 4, 5, 6, 7)] == [None, None, "net/de/", None, "example.net/de/8", "net/de/"]
    assert got[2]["verdict"] == "allow" and got[6]["verdict"] == "block"
    assert url_trust.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0
    assert F is not None


def test_rank_equals_a_plain_iteration(spark):
    links = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 3.0)]
    seeds = [("a", 1.0, 0.0), ("c", 0.0, 2.0), ("d", 1.0, 0.0)]
    got = url_trust.propagate(
        spark.createDataFrame(links, "src string, dst string, w double"),
        spark.createDataFrame(seeds, "host string, good double, bad double"),
        tolerance=1e-9,
    )
    want = {}
    for col, ways in (("trust", links), ("distrust", [(b, a, w) for a, b, w in links])):
        seed = {h: (g if col == "trust" else b) for h, g, b in seeds}
        seed = {h: x / sum(seed.values()) for h, x in seed.items()}
        outs = defaultdict(float)
        for a, _, w in ways:
            outs[a] += w
        now = dict(seed)
        for _ in range(200):  # rank at hosts without links goes back to the seeds
            lost = sum(x for h, x in now.items() if not outs[h])
            new = defaultdict(float)
            for h, x in seed.items():
                new[h] += (0.15 + 0.85 * lost) * x
            for a, b, w in ways:
                new[b] += 0.85 * now.get(a, 0) * w / outs[a]
            now = new
        assert sum(now.values()) == pytest.approx(1)
        want[col] = now
    for r in got.collect():
        assert r["trust"] == pytest.approx(want["trust"].get(r["host"], 0))
        assert r["distrust"] == pytest.approx(want["distrust"].get(r["host"], 0))


def test_distrust_spreads_back_and_trust_forward(spark):
    pages = [
        (1, "http://bad.test/x", ""),
        (2, "http://farm.test/x", '<a href="http://bad.test/1">'),
        (3, "http://good.test/x", '<a href="http://friend.test/1"> <a href="//FRIEND.test/2">'),
        (4, "http://friend.test/x", ""),
        (5, "http://lonely.test/x", ""),
    ]
    out = url_trust.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string, html string"), {}, trusted=("good.test",), blocked=("bad.test",)
    )
    got = {r["id"]: r["verdict"] for r in out.collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_distrust_reaches_along_a_chain_of_hosts(spark):
    """Thirty hosts that each link to the next, the last one blocked; and a repeated page, a tie, and clashing columns."""
    pages = [(k, f"http://h{k}.test/", f'<a href="http://h{k + 1}.test/">', 1, 2) for k in range(30)] + [(30, "http://h30.test/", "", 1, 2), (0, "http://h0.test/", '<a href="http://h1.test/">', 1, 2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host int, trust int")
    out = url_trust.judge_urls(df, {}, blocked=("h30.test",), few=0).collect()
    assert len(out) == 32 and {r["verdict"] for r in out} == {"block"} and len({r["host"] for r in out}) == 31
    tie = [(1, "http://a.test/", '<a href="http://m.test/">', 1, 2), (2, "http://m.test/", '<a href="http://b.test/">', 1, 2), (3, "http://b.test/", "", 1, 2)]
    tied = url_trust.judge_urls(spark.createDataFrame(tie, df.schema), {}, trusted=("a.test",), blocked=("b.test",)).collect()
    m = next(r for r in tied if r["id"] == 2)
    assert m["trust"] == pytest.approx(m["distrust"]) and m["verdict"] == "allow"
