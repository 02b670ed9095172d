import re

import corpus_pipeline
from lumora.llm import quality
from lumora.session import settle
from tests.llm.test_first_operators import grouped, naive_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {r["doc_id"]: r for r in docs.collect()}
    want_kept = {}
    rules = dict(quality.RULES)
    names = [x.split()[0] for x in quality.MEASURES.split(", ")]
    for k, r in given.items():
        m = dict(zip(names, quality.measure(r["text"])))
        if not any(eval(rules[n], {}, m) for n in quality.POLICIES["v4"]):
            want_kept[k] = r
    now = settle(corpus_pipeline.keep_quality(spark, docs, sf))
    assert now.columns == COLUMNS and {r["doc_id"]: r for r in now.collect()} == want_kept

    prints = {k: naive_fingerprint(r["text"]) for k, r in want_kept.items()}
    ids = sorted(prints)
    top = grouped(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    now = settle(corpus_pipeline.drop_near_duplicates(spark, now, sf))
    rows = {r["doc_id"]: r for r in now.collect()}
    assert now.columns == COLUMNS and rows == {k: r for k, r in want_kept.items() if top[k] == k}

    now = settle(corpus_pipeline.replace_personal_data(spark, now, sf))
    assert now.columns == COLUMNS
    for r in now.collect():
        old = rows[r["doc_id"]]["text"]
        assert r["n_chars"] == len(r["text"])
        looks = re.findall(r"\S+@\S+\.com|AKIA\w{16}", old)
        assert not any(x in r["text"] for x in looks)
        if not re.search(r"[0-9@]", old):
            assert r["text"] == old
    texts = {r["doc_id"]: r["text"] for r in now.collect()}

    now = settle(corpus_pipeline.mix_sources(spark, now, sf))
    assert now.columns == COLUMNS
    repeats = {}
    for r in now.collect():
        assert texts[r["doc_id"]] == r["text"]
        repeats[r["doc_id"]] = repeats.get(r["doc_id"], 0) + 1
    packed = corpus_pipeline.pack_sequences(spark, now, sf).toPandas()
    assert packed[packed.piece == 0].groupby("doc_id").size().to_dict() == repeats
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_odd_and_empty_documents(spark, sf):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, text, "en", "a", 9), (None, text, "en", None, 9), (3, text, "en", "b", 9), (3, text, "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, count in ((docs, 1), (docs.limit(0), 0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:3]:
            now = settle(stage(spark, now, sf))
        assert now.count() == count
        for _, stage in corpus_pipeline.STAGES[3:]:
            now = settle(stage(spark, now, sf))
        assert now.columns[0] == "doc_id"
