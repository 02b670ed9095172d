"""The Merkle manifest against plain Python: levels, proofs, tampering, odd rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumora.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, more=0):
    return digest("".join(map(told, (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def expected(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        built[name] = levels([x[2] for x in trees[name]])
    top = levels([built[n][-1][0] for n in names])
    out = []
    for rank, name in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(trees[name]):
            key = r["doc_id"]
            folded = leaf_of(r, 1) if key is not None and zlib.crc32(str(key).encode()) % 7 == 0 else leaf
            proof = ""
            for tree, at in ((built[name], i), (top, rank)):
                for level in tree[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += "".join(h for k, h in enumerate(run) if k != at % 2)
                    run[at % 2] = folded
                    folded = digest("".join(run))
                    at //= 2
            out.append((key, leaf, built[name][-1][0], top[-1][0], digest(proof), folded, folded == top[-1][0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("stride", [1, 2, 8])
def test_equals_plain_python(spark, sf, stride):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = merkle.manifest(docs, merkle.tampered(docs), stride=stride)
    assert sorted(str(tuple(r)) for r in got.collect()) == expected(docs.collect())


def test_nulls_repeats_ties_and_lone_trees(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "a", "en", "s", 1)] * 4 + [(5, "b", "en", "s", None), (7, "", "", "é", 9223372036854775807)]
    rows += [(k, "x" * 300_000, "fr", None, k) for k in range(40, 57)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    more = docs.select("*", *(F.lit(1).alias(c) for c in "tree place load hash leaf claimed id pos n hop".split()))
    want = expected(docs.collect())
    for df in (docs, more):
        got = merkle.manifest(df, merkle.tampered(df), stride=3).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert merkle.manifest(docs.limit(0), merkle.tampered(docs)).count() == 0
    one = merkle.manifest(docs.where("doc_id = 7")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == digest("") and one["verified"]


def test_many_trees(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 37).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert sorted(str(tuple(r)) for r in merkle.manifest(docs, merkle.tampered(docs), stride=2).collect()) == expected(docs.collect())
