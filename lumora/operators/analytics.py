"""Memories, places, map buckets, trips, near duplicates, vector clusters and evaluation."""

from __future__ import annotations

from datetime import date
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions import scalars as S
from lumora.operators.components import components
from lumora.operators.density import Grid, density_grid
from lumora.operators.vectors import near_vectors
from lumora.session import settle


def listed(ids: Column) -> Column:
    """A sorted list of ids as text with commas."""
    return F.array_join(F.array_sort(ids), ",")


# memories -----------------------------------------------------------------------------------------------------------


def on_this_day(assets: DataFrame, today: date, window: int = 3) -> DataFrame:
    """(year, years_ago, n, ids): rows of other years within window days of today's place in the year.

    Days that today's year lacks (Feb 29) drop out. The ids of a year are at most those of seven days.
    """
    taken = S.day_date(F.col("day"))
    here = S.onto_year(taken, today.year)
    near = S.circular_days(here, F.lit(today)) <= window
    hit = assets.where("day is not null").where((F.year(taken) != today.year) & near)
    by = hit.groupBy(F.year(taken).alias("year"))
    return by.agg(F.count("*").alias("n"), F.collect_list("id").alias("ids")).select("year", (F.lit(today.year) - F.col("year")).alias("years_ago"), "n", listed(F.col("ids")).alias("ids"))


def year_highlights(assets: DataFrame, today: date) -> DataFrame:
    """(year, bimonth, n_year, highlight): the upper median id of each two months of each past year."""
    taken = S.day_date(F.col("day"))
    past = assets.where("day is not null").select("id", F.year(taken).alias("year"), F.floor((F.month(taken) - 1) / 2).cast("int").alias("bimonth"))
    past = past.where(F.col("year") < today.year)
    w = Window.partitionBy("year", "bimonth")
    ranked = past.withColumn("r", F.row_number().over(w.orderBy("id"))).withColumn("n", F.count("*").over(w))
    picked = ranked.where("r = n div 2 + 1").select("year", "bimonth", F.col("id").alias("highlight"))
    return picked.join(past.groupBy("year").agg(F.count("*").alias("n_year")), "year")


def person_years(faces: DataFrame, assets: DataFrame, today: date, least: int = 3) -> DataFrame:
    """(person_id, year, n, first_id, last_id): persons with at least `least` different assets in a past year."""
    out = person_assets(faces, assets, today).groupBy("person_id", "year").agg(F.count("*").alias("n"), F.min("asset_id").alias("first_id"), F.max("asset_id").alias("last_id"))
    return out.where(F.col("n") >= max(1, least))


def parts_for(rows: DataFrame, share: int = 500_000) -> int:
    """Partitions of at most about `share` rows each: what a task holds must not follow the table's size."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // share))


def person_assets(faces: DataFrame, assets: DataFrame, today: date) -> DataFrame:
    """(person_id, year, asset_id), distinct: the dated assets of past years that a person is on."""
    taken = S.day_date(F.col("day"))
    dated = assets.where("day is not null").select(F.col("id").alias("asset_id"), F.year(taken).alias("year")).where(F.col("year") < today.year)
    parts = parts_for(faces)  # by number: adaptive execution would gather them into as many as there are cores
    seen = faces.where("person_id is not null").select("person_id", "asset_id").repartition(parts, "asset_id")
    return seen.join(dated.repartition(parts, "asset_id"), "asset_id").select("person_id", "year", "asset_id").distinct()


# places -------------------------------------------------------------------------------------------------------------


def named_points(points: DataFrame) -> DataFrame:
    """points(lat, lon) with place (city, region, country); coordinates are looked up once each."""
    spots = points.where("lat is not null and lon is not null").select("lat", "lon").distinct()
    met = spots.withColumn("cell", S.city_cell(F.col("lat"), F.col("lon"))).join(F.broadcast(S.cities_by_cell(points.sparkSession)), "cell", "left")
    named = met.select("lat", "lon", S.nearest_city(F.col("lat"), F.col("lon"), table=F.col("near")).alias("place"))
    return points.join(named, ["lat", "lon"]).where("place is not null")


def places(points: DataFrame, samples: int = 6) -> DataFrame:
    """(place_id, city, region, country, n, lat, lon, sample): groups of named points and a strided sample of their ids."""
    named = named_points(points).select("asset_id", "lat", "lon", "place.city", "place.country", "place.region")
    named = named.withColumn("place_id", F.concat_ws(":", "country", "city"))
    sums = named.groupBy("place_id").agg(
        F.first("city").alias("city"), F.min("region").alias("region"), F.first("country").alias("country"), F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")
    )
    stride = F.floor(F.greatest("n", F.lit(samples)) / samples)
    ranked = named.join(F.broadcast(sums.select("place_id", "n")), "place_id")  # at most one row a city of the table
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("place_id").orderBy("asset_id")) - 1)
    taken = ranked.where((F.col("r") % stride == 0) & (F.col("r") < stride * samples)).groupBy("place_id").agg(listed(F.collect_list("asset_id")).alias("sample"))
    return sums.join(taken, "place_id")


def map_points(points: DataFrame, day_from: int | None = None, day_to: int | None = None, source_id: int | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """points(asset_id, source_id, lat, lon, day) that have a position and pass the filters; hidden(asset_id) are left out if given."""
    out = points.where("lat is not null and lon is not null")
    for test, value in ((F.col("day") >= day_from, day_from), (F.col("day") <= day_to, day_to), (F.col("source_id") == source_id, source_id)):
        out = out if value is None else out.where(test)
    return out if hidden is None else out.join(hidden.select("asset_id"), "asset_id", "left_anti")


def map_grid(points: DataFrame, zoom: float) -> DataFrame:
    """(gx, gy, n, lat, lon): buckets of a world grid of 2 / zoom degrees."""
    g = 2.0 / max(zoom, 1.0)
    on = points.where("lat is not null and lon is not null")
    by = on.groupBy(F.floor(F.col("lon") / g).alias("gx"), F.floor(F.col("lat") / g).alias("gy"))
    return by.agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def placed_values(rows: DataFrame, wanted: dict[str, tuple[str, float]], slots: int = 1024) -> dict[str, float | None]:
    """For each name of wanted(column, share): the value at place floor(n * share), n - 1 at most, of the column's order; null if there are no rows.

    Rounds of histograms: the slot that holds the place is the next range, until it holds one value only. A round counts `slots` slots a name, so
    neither a sort nor a window is needed, whatever the number of rows or ties.
    """
    head = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{m}") for k, (c, _) in wanted.items() for f, m in ((F.min, "lo"), (F.max, "hi")))).first()
    n = head["n"]
    if not n:
        return dict.fromkeys(wanted)
    state = {k: (head[f"{k}_lo"], head[f"{k}_hi"], min(int(n * share), n - 1)) for k, (_, share) in wanted.items()}
    while open_ := {k: v for k, v in state.items() if v[0] < v[1]}:
        parts = []
        for k, (lo, hi, _) in open_.items():
            v = F.col(wanted[k][0]).cast("double")
            slot = F.least(F.floor((v - F.lit(lo)) / (F.lit(hi) - F.lit(lo)) * slots), F.lit(slots - 1)).cast("int")
            parts.append(F.when((v >= lo) & (v <= hi), F.struct(F.lit(k).alias("name"), slot.alias("slot"), v.alias("v"))))
        each = rows.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).groupBy("x.name", "x.slot")
        got = each.agg(F.count("*").alias("k"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi")).collect()
        for name, (_, _, place) in open_.items():
            for r in sorted((r for r in got if r["name"] == name), key=lambda r: r["slot"]):
                if place < r["k"]:
                    state[name] = (r["lo"], r["hi"], place)
                    break
                place -= r["k"]
    return {k: v[0] for k, v in state.items()}


def bounds(points: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: for lat and lon the values at places floor(n * low) and floor(n * high) of their order; nulls without points."""
    on = points.where("lat is not null and lon is not null")
    got = placed_values(on, {f"{c}_{e}": (c, p) for c in ("lat", "lon") for e, p in (("low", low), ("high", high))})
    return points.sparkSession.createDataFrame([tuple(got.values())], ", ".join(f"{k} double" for k in got))


def fitted_view(edges: DataFrame, width: float = 720.0, height: float = 360.0) -> DataFrame:
    """bounds with span_lat, span_lon (one degree at least), zoom and the centre (cx, cy) on a canvas of the whole world at zoom 1.

    The tighter of both axes fills four fifths of the canvas, zoom is 8 at most; without points the whole world at zoom 1.
    """
    lat, lon = F.greatest(F.col("lat_high") - F.col("lat_low"), F.lit(1.0)), F.greatest(F.col("lon_high") - F.col("lon_low"), F.lit(1.0))
    out = edges.withColumns({"span_lat": lat, "span_lon": lon})
    fit = F.least(F.lit(180 * 0.8) / F.col("span_lat"), F.lit(360 * 0.8) / F.col("span_lon"), F.lit(8.0))
    middle = lambda c: (F.col(f"{c}_low") + F.col(f"{c}_high")) / 2
    cx, cy = middle("lon") / 360 * width, -(middle("lat") / 180) * height
    return out.withColumns({"zoom": F.when(F.col("lat_low").isNull(), 1.0).otherwise(F.least(F.greatest(fit, F.lit(1.0)), F.lit(128.0))), "cx": F.coalesce(cx, F.lit(0.0)), "cy": F.coalesce(cy, F.lit(0.0))})


# density clusters ---------------------------------------------------------------------------------------------------


def density_clusters(pairs: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """(id, cluster) of every point: DBSCAN from its neighbour pairs(a, b), each pair once and without self pairs.

    A core has `least` neighbours including itself; clusters are components of cores and take the smallest core's id;
    other points join the neighbouring cluster of smallest id (the order of discovery of a sequential
    run is not kept), and the rest is noise, cluster null.
    """
    both = settle(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    cores = settle(both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least).select(F.col("a").alias("id")))
    if least <= 1:
        cores = points.select("id")
    inner = both.join(cores.withColumnRenamed("id", "a"), "a", "left_semi").join(cores.withColumnRenamed("id", "b"), "b", "left_semi").where("a < b")
    roots = components(inner.select("a", "b"))
    named = settle(cores.join(roots, cores["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("cluster")))
    edge = both.join(named.withColumnRenamed("id", "b"), "b").join(cores.withColumnRenamed("id", "a"), "a", "left_anti")
    border = edge.groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    return points.select("id").join(named.unionByName(border), "id", "left")


def trip_points(points: DataFrame, eps_km: float, eps_days: float) -> DataFrame:
    """points(asset_id, lat, lon, day) in kilometres: longitude shrinks with each point's own latitude, days scale to eps."""
    on = points.where("lat is not null and lon is not null and day is not null")
    return on.select(
        F.col("asset_id").alias("id"), "lat", "lon", "day",
        (F.col("lat") * 111.0).alias("x"), (F.col("lon") * 111.0 * F.cos(F.radians("lat"))).alias("y"), (F.col("day") * (eps_km / eps_days)).alias("z"),
    )


def trip_labels(points: DataFrame, eps_km: float = 50.0, eps_days: float = 3.0, least: int = 5) -> DataFrame:
    """(asset_id, trip_id, lat, lon, day) of the points in a trip: density clusters in space and time, one row a member."""
    scaled = trip_points(points, eps_km, eps_days)
    found = density_grid(scaled, Grid(eps_km, least)).where("cluster is not null").select("id", F.col("cluster").alias("trip_id"))
    return scaled.join(found, "id").select(F.col("id").alias("asset_id"), "trip_id", "lat", "lon", "day")


def trips(points: DataFrame, eps_km: float = 50.0, eps_days: float = 3.0, least: int = 5) -> DataFrame:
    """(trip_id, n, lat, lon, start_day, end_day, place, label) of density clusters in space and time."""
    out = trip_labels(points, eps_km, eps_days, least).groupBy("trip_id").agg(
        F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("day").alias("start_day"), F.max("day").alias("end_day")
    )
    named = out.withColumn("place", S.nearest_city(F.col("lat"), F.col("lon"))["city"])
    days = S.range_label(S.day_date(F.col("start_day")), S.day_date(F.col("end_day")))
    name = F.coalesce("place", F.concat(F.lit("Trip · "), F.col("n").cast("string"), F.lit(" photos")))
    return named.withColumn("label", F.concat(name, F.lit(" · "), days))


def trip_members(points: DataFrame, eps_km: float = 50.0, eps_days: float = 3.0, least: int = 5) -> DataFrame:
    """(trip_id, start_day, members, content_id): the sorted ids of every trip as text, and their digest, equal for equal members.

    For trips that one display holds; `trip_labels` has the same members as rows, for trips of any size.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("asset_id")), lambda i: i.cast("string")), ",")
    out = trip_labels(points, eps_km, eps_days, least).groupBy("trip_id").agg(F.min("day").alias("start_day"), ids.alias("members"))
    return out.withColumn("content_id", F.sha2("members", 256))


# near duplicates of 64-bit hashes -----------------------------------------------------------------------------------


#: What comparing a pair costs, next to a row; members of a key that are joined as rows; members that meet in one block; pairs a task.
PAIR, FEW, HASH_BLOCK, TASK = 0.005, 256, 8192, 2e7


def _wide_bands(n: int, most: int, bands: tuple[tuple[int, int], ...]) -> list[list[tuple[int, int]]]:
    """Keys for n hashes, each a list of (shift, width) parts: a pair at most `most` bits apart agrees on one key at least.

    The 64 bits are cut into blocks; of m blocks m - most are untouched by `most` bits, so a key for each choice of that many blocks finds every pair. More blocks give longer keys and more
    of them. The way with the fewest rows and expected meetings is taken, the rule's own bands among them.
    """
    price = lambda w: n + PAIR * n * n / 2.0**w
    best, cost = [[b] for b in bands], sum(price(w) for _, w in bands)
    for m in range(most + 1, min(64, most + 8) + 1):
        cuts = [64 * k // m for k in range(m + 1)]
        blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        keys = [list(c) for c in combinations(blocks, m - most)] if comb(m, m - most) <= 300 else []
        now = sum(price(sum(w for _, w in k)) for k in keys)
        if keys and now < cost:
            best, cost = keys, now
    return best


def near_hashes(hashes: DataFrame, most: int, bands: tuple[tuple[int, int], ...] = ((60, 4), (56, 4))) -> DataFrame:
    """Pairs (a, b, bits) of hashes(id, hash) at most `most` bits apart that agree on one of the bands (shift, width).

    Distinct hashes meet, each with the ids it stands for hung on the smallest, so groups of equal images cost one row. They meet under the keys of `_wide_bands`,
    exactly: the bands of the rule are the last filter, and keys only where nothing longer finds every pair. Members of a key that are few meet in a join, many are
    dealt into blocks and compared block against block by xor, so no task gets a whole key.
    """
    same = settle(hashes.groupBy("hash").agg(F.min("id").alias("least")))
    stars = hashes.join(same, "hash").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"), F.lit(0).alias("bits"))
    part = lambda c, s, w: F.shiftrightunsigned(c, s).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1).cast("long"))
    keys = []
    for k, parts in enumerate(_wide_bands(same.count(), most, bands)):
        value = F.lit(0).cast("long")
        for s, w in parts:
            value = F.shiftleft(value, w).bitwiseOR(part("hash", s, w))
        keys.append(F.struct(F.lit(k).alias("k"), value.alias("v")))
    posts = settle(same.select("least", "hash", F.explode(F.array(*keys)).alias("p")).select("least", "hash", "p.k", "p.v"))
    members = settle(posts.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"))
    few, many = members.where(F.col("n") <= FEW).select("k", "v"), members.where(F.col("n") > FEW)
    bits = S.hamming(F.col("hash"), F.col("hash2"))
    shared = F.lit(False)
    for s, w in bands:
        shared = shared | (part("hash", s, w) == part("hash2", s, w))
    # keys by the thousand times as many rows as files tell: they are sorted and merged, never sent whole to the driver
    short = posts.join(few.hint("merge"), ["k", "v"])
    other = short.select(F.col("least").alias("least2"), F.col("hash").alias("hash2"), "k", "v")
    met = short.join(other.hint("merge"), ["k", "v"]).where((F.col("least") < F.col("least2")) & (bits <= most) & shared)
    pairs = met.select(F.col("least").alias("a"), F.col("least2").alias("b"), bits.alias("bits"))
    masks = [((1 << w) - 1) << s for s, w in bands]

    def meet(table: pa.Table) -> pa.Table:
        ids, hash_, block = table.column("least").to_numpy(), table.column("hash").to_numpy().view(np.uint64), table.column("block").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            apart = hash_[some][:, None] ^ hash_[right][None]
            x, y = np.nonzero(np.bitwise_count(apart) <= most)
            one, two, apart = ids[some[x]], ids[right[y]], apart[x, y]
            good = np.any([apart & np.uint64(m) == 0 for m in masks], axis=0) & (one < two if i == j else one != two)
            one, two = one[good], two[good]
            found.append((np.minimum(one, two), np.maximum(one, two), np.bitwise_count(apart[good]).astype(np.int32)))
        return pa.table({n: np.concatenate([f[k] for f in found]) for k, n in enumerate(("a", "b", "bits"))})

    blocks = many.withColumn("parts", F.ceil(F.col("n") / HASH_BLOCK).cast("int")).drop("n")
    work = many.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0.0
    dealt = posts.join(blocks.hint("merge"), ["k", "v"]).withColumn("block", F.pmod(F.xxhash64("hash", F.lit(5)), "parts").cast("int"))
    dealt = dealt.select("least", "hash", "k", "v", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    dealt = dealt.withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o")
    dealt = dealt.repartition(max(8, min(10_000, int(work / TASK))), "k", "v", "i", "j")  # few bytes, much work: not to be put together by size
    pairs = pairs.unionByName(dealt.groupBy("k", "v", "i", "j").applyInArrow(meet, "a long, b long, bits int"))
    return pairs.distinct().unionByName(stars)


def near_clusters(hashes: DataFrame, most: int, quality: DataFrame | None = None) -> DataFrame:
    """(cluster, id, is_best): components of near hashes, of two members at least; best is the highest quality, then the smallest id."""
    found = components(near_hashes(hashes, most)).select(F.col("root").alias("cluster"), F.col("node").alias("id"))
    found = found.join(quality, "id", "left") if quality is not None else found.withColumn("quality", F.lit(0.0))
    w = Window.partitionBy("cluster").orderBy(F.col("quality").desc_nulls_last(), "id")
    return found.withColumn("is_best", F.row_number().over(w) == 1).select("cluster", "id", "is_best")


# vectors ------------------------------------------------------------------------------------------------------------


def vector_clusters(vectors: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, cluster) by density with cosine distance at most eps; noise is null."""
    pairs = near_vectors(vectors, 1.0 - eps)
    return density_clusters(pairs, vectors.select(F.col("asset_id").alias("id")), least)


def centroids(labelled: DataFrame, key: str) -> DataFrame:
    """(key, n, centroid): normalised element-wise means of vec; rows whose key is null or negative don't count."""
    long = labelled.where(F.col(key).isNotNull() & (F.col(key) >= 0)).select(key, F.posexplode("vec").alias("i", "x"))
    means = long.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    out = means.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return out.select(key, "n", S.normalised(F.col("c")).alias("centroid"))


def merged_clusters(cents: DataFrame, key: str, most: float) -> DataFrame:
    """(key, merged): clusters whose centroids are within `most` cosine distance share the smallest key."""
    vectors = cents.select(F.col(key).cast("long").alias("asset_id"), F.col("centroid").alias("vec"))
    roots = components(near_vectors(vectors, 1.0 - most).select("a", "b"))
    own = cents.select(F.col(key).cast("long").alias(key))
    return own.join(roots, own[key] == roots["node"], "left").select(key, F.coalesce("root", key).alias("merged"))


def pairwise_f1(labelled: DataFrame, truth: str, found: str) -> DataFrame:
    """One row tp, fp, fn, precision, recall, f1 over all pairs, from the contingency table; rows without a cluster are alone."""
    pairs = lambda n: n * (n - 1) / 2
    both = labelled.where(F.col(found).isNotNull()).groupBy(truth, found).agg(F.count("*").alias("n"))
    tp = both.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("tp"))
    got = both.groupBy(found).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("got"))
    real = labelled.groupBy(truth).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("real"))
    one = tp.crossJoin(got).crossJoin(real)  # three single rows
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    one = one.withColumn("precision", ratio(F.col("tp"), F.col("got"))).withColumn("recall", ratio(F.col("tp"), F.col("real")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return one.select("tp", (F.col("got") - F.col("tp")).alias("fp"), (F.col("real") - F.col("tp")).alias("fn"), "precision", "recall", f1.alias("f1"))
