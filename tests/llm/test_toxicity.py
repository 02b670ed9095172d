"""FTRL against a plain dictionary version, held-out accuracy, odd rows."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumora.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string"


def plain_train(rows, by):
    """The same rule, one coordinate after another, in dictionaries."""
    sets = [set(map(int, toxicity.features(t, by.bits))) for _, t in rows]
    seen = {}
    for s in sets:
        for f in s:
            seen[f] = seen.get(f, 0) + 1
    z, n, base = {}, {}, [0.0, 0.0]

    def w(f):
        a = z.get(f, 0.0)
        return 0.0 if abs(a) <= by.l1 else (math.copysign(by.l1, a) - a) / ((by.beta + math.sqrt(n[f])) / by.alpha + by.l2)

    def b():
        return -base[0] / ((by.beta + math.sqrt(base[1])) / by.alpha)

    for _ in range(by.passes):
        for (label, _), s in zip(rows, sets):
            s = [f for f in s if seen[f] >= by.least_rows]
            was = {f: w(f) for f in s}
            g = 1 / (1 + math.exp(-max(-35, min(35, b() + sum(was.values()))))) - label
            for f in s:
                grown = n.get(f, 0.0) + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(grown) - math.sqrt(n.get(f, 0.0))) / by.alpha * was[f]
                n[f] = grown
            now = b()
            grown = base[1] + g * g
            base = [base[0] + g - (math.sqrt(grown) - math.sqrt(base[1])) / by.alpha * now, grown]
    return {-1: b(), **{f: w(f) for f in z if w(f)}}


def test_training_equals_a_plain_version():
    draw = random.Random(4)
    rows = [(k % 3 == 0, " ".join(draw.choices("the of bad words good tree house river".split(), k=12)) + (" awful" if k % 3 == 0 else "")) for k in range(40)]
    by = toxicity.Learner(l1=0.7, passes=3)
    got = toxicity.train([(int(y), t) for y, t in rows], by)
    want = plain_train([(int(y), t) for y, t in rows], by)
    assert got["feature"].is_unique and set(got["feature"]) == set(want)
    assert all(math.isclose(w, want[f], rel_tol=1e-9, abs_tol=1e-12) for f, w in zip(got["feature"], got["weight"]))


def test_words_don_t_depend_on_slices(monkeypatch):
    text = "Früh am Morgen, a verylongwordthatgoesonandon idiot! x\ny " * 200 + "u" * 900
    want = toxicity.word_hashes(text)
    monkeypatch.setattr(toxicity, "SLICE", 64)
    assert all((a == b).all() for a, b in zip(want, toxicity.word_hashes(text)))
    assert len(want[0]) == 200 * 8 + 1 and len(toxicity.features("")) == len(toxicity.features(None)) == 0


def test_scores_held_out(spark):
    """At the scale with enough labels: ranking and threshold on rows that were never learnt, and no use of other columns."""
    d = "/root/testdata/sf0.1"
    out = queries.op12_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    bad, good = out[out["toxic"] == 1]["score"].to_numpy(), out[out["toxic"] == 0]["score"].to_numpy()
    area = (bad[:, None] > good[None]).mean() + 0.5 * (bad[:, None] == good[None]).mean()
    assert len(bad) > 50 and area > 0.97
    assert (bad >= 0.5).mean() > 0.8 and (good >= 0.5).mean() < 0.01


def test_odd_rows(spark):
    rows = [(k, ("you awful fool " if k % 2 else "a fine calm day ") * 4, "en") for k in range(60)]
    odd = [(None, "you awful fool", "en"), (100, None, "en"), (101, "", "en"), (102, "fine day " * 400_000, None), (103, "q" * 3_000_000, None), (1, rows[1][1], "en")]
    docs = spark.createDataFrame(rows + odd, DOCS).repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (100, 1), (7, None), (101, 0), (1, 1)], "doc_id long, toxic int")
    by = toxicity.Learner(l1=0.5)
    out = toxicity.toxic_documents(docs, labels, by).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    at = {r["doc_id"]: r for r in out}
    assert at[3]["predicted"] == 1 and at[4]["predicted"] == 0 and at[None]["predicted"] == 1 and not at[None]["held_out"]
    assert at[100]["score"] == at[101]["score"] and at[102]["score"] < at[101]["score"]
    again = toxicity.toxic_documents(docs.coalesce(1).select("*", *(F.lit(3).alias(c) for c in "id label drawn score toxic share".split())), labels.repartition(2), by)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    assert toxicity.toxic_documents(docs.limit(0), labels, by).count() == 0
    assert {r["score"] for r in toxicity.toxic_documents(docs, labels.limit(0), by).collect()} == {0.5}


def test_scores_need_few_weights():
    model = pd.DataFrame({"feature": [-1, int(toxicity.features("fool")[0])], "weight": [-1.0, 3.0]})
    score = toxicity.scorer(model)
    assert np.isclose(score("what a Fool!"), 1 / (1 + math.exp(-2))) and np.isclose(score("fool fool"), score("fool")) and np.isclose(score("calm"), 1 / (1 + math.e))
