"""Versioned tables, the stored token index, global places."""

import pytest
from pyspark.sql import functions as F

from lumora.operators import text_index as T
from lumora.operators.order import numbered
from lumora.sources import versions


def test_versions_are_whole_and_atomic(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.current(spark, path, "id long").count() == 0
    versions.publish(spark.range(5), path)
    old = versions.current(spark, path)
    with pytest.raises(Exception, match="lost"):
        versions.publish(spark.range(10).select(F.when(F.col("id") > 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id")), path)
    assert versions.current(spark, path).count() == 5
    new = versions.publish(spark.range(9), path)
    assert new.count() == 9 and old.count() == 5  # who began to read before still can
    versions.publish(versions.current(spark, path).where("id < 3"), path)  # from itself
    assert versions.current(spark, path).count() == 3


def test_stored_index(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(1, "The quick brown fox"), (2, "quick FOX, fox"), (3, None), (4, ""), (None, "fox")] + [(k, "the " + "filler" * (k % 3)) for k in range(10, 300)]
    docs = spark.createDataFrame(rows, "id long, text string")
    T.store(docs, "k", path)
    find = lambda q, key="k", limit=None: [r["id"] for r in T.search_stored(spark, path, q, key, limit).collect()]
    assert find("fox quick") == [1, 2] and find("BROWN the") == [1] and find("menu") == [] and find("") == [] and find("fox", "other") == []
    assert find("the", limit=7) == [1, *range(10, 16)]
    lines = spark.createDataFrame([(1, '[{"text":"boarding pass"},{"text":"Flight SQ22"}]'), (2, "broken")], "id long, lines string")
    T.store_lines(lines, "k", path, 1)
    assert find("flight sq22") == [1] and find("boarding flight") == [1] and find("fox") == [] and find("the")[0] == 10
    token = spark.range(1).select(F.explode(F.array(F.lit("fox"))).alias("w")).select(T.S.blind("k", F.col("w"))).first()[0]
    read = T.stored(spark, path, [token])
    assert {f.split("prefix=")[1][:2] for f in read.inputFiles()} > {token[:2]}  # all are known
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and token[:2] in plan.split("PartitionFilters")[1].split("]")[0] and "token" in plan.split("PushedFilters")[1].split("\n")[0]


def test_ids_of_a_token_are_stored_together(spark, tmp_path):
    """A word is blinded, dealt and sorted once for the ids that meet in a task, not once for each; the index is the same."""
    rows = [(k, f"The {'fox' * (k % 2)} Éa{k % 5}, the") for k in range(200)] + [(7, "fox again"), (None, "fox"), (300, None), (301, " ! ")]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    want = sorted(map(str, T.token_index(docs, "k").collect()))
    for most, parts in ((1_000_000, 1), (100, 5)):
        got = T.postings(docs, "k", most=most)
        assert sorted(map(str, got.select("token", F.explode("ids").alias("id")).collect())) == want
        assert got.groupBy("token").count().agg(F.max("count")).first()[0] <= parts + 1 < 9
    T.store(docs, "k", str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/tokens")).count() == len({r.split("'")[1] for r in want}) == 8
    assert sorted(map(str, T.stored(spark, str(tmp_path / "index")).select("token", "id").collect())) == want


def test_places_are_gapless(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 11 == 0, None).otherwise(F.hash("id") % 50).alias("k"), "id").repartition(7)
    got = numbered(df, [F.col("k").desc_nulls_last(), F.col("id")], "place").orderBy("place").collect()
    want = sorted(df.collect(), key=lambda r: (r["k"] is None, -(r["k"] or 0), r["id"]))
    assert [(r["k"], r["id"], r["place"]) for r in got] == [(r["k"], r["id"], i) for i, r in enumerate(want)]
