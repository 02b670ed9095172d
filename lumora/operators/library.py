"""Filters, visibility, paging, search, saved rules, albums and people over catalogue tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions import scalars as S

FIRST_CURSOR = (1 << 62, 1 << 62)
PAGE, PAGE_MAX = 120, 500


def hidden_assets(members: DataFrame, collections: DataFrame) -> DataFrame:
    """asset_id of everything that is in any hidden collection."""
    hidden = collections.where("kind = 'hidden_vault'").select(F.col("id").alias("collection_id"))
    return members.join(hidden, "collection_id", "left_semi").select("asset_id").distinct()


def visible(assets: DataFrame, hidden: DataFrame, key: str = "id") -> DataFrame:
    """Rows that are in no hidden collection: an anti join, whatever else the row belongs to."""
    return assets.join(hidden.select(F.col("asset_id").alias(key)), key, "left_anti")


def owned(assets: DataFrame, sources: DataFrame, owner: int) -> DataFrame:
    mine = sources.where(F.col("owner_id") == owner).select(F.col("id").alias("source_id"))
    return assets.join(mine, "source_id", "left_semi")


def newest_first() -> list[Column]:
    """The one total order of a feed; a row without a day counts as day 0."""
    return [F.coalesce("day", F.lit(0)).desc(), F.col("id").desc()]


def page(assets: DataFrame, cursor: tuple[int, int] = FIRST_CURSOR, limit: int | None = None) -> DataFrame:
    """The rows after a cursor (day, id) in feed order: a keyset, so later pages cost what the first one does."""
    day, row = F.coalesce("day", F.lit(0)), F.col("id")
    after = (day < cursor[0]) | ((day == cursor[0]) & (row < cursor[1]))
    return assets.where(after).orderBy(*newest_first()).limit(min(limit or PAGE, PAGE_MAX))


def next_cursor(rows: DataFrame) -> tuple[int, int] | None:
    """The cursor of the last row of a page; None where the page is empty."""
    last = rows.select(F.min(F.struct(F.coalesce("day", F.lit(0)).cast("long").alias("d"), "id")).alias("c")).first()["c"]
    return (last["d"], last["id"]) if last else None


def album_page(assets: DataFrame, members: DataFrame, albums: DataFrame, album: int, unlocked: set[int], cursor: tuple[int, int] = FIRST_CURSOR, limit: int | None = None) -> DataFrame:
    """A page of one of albums(album, has_password); one with a password that is not unlocked shows nothing."""
    open_ = albums.where((F.col("album") == album) & (~F.col("has_password") | F.lit(album in unlocked))).select(F.col("album").alias("collection_id"))
    own = members.where(F.col("collection_id") == album).join(open_, "collection_id", "left_semi").select(F.col("asset_id").alias("id"))
    return page(assets.join(own, "id", "left_semi"), cursor, limit)


def counted(collections: DataFrame, members: DataFrame) -> DataFrame:
    """collections with n, the number of their members, 0 included."""
    n = members.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n"))
    return collections.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hydrated(ids: list[int], assets: DataFrame) -> DataFrame:
    """Rows of a list of ids in the list's order; repeats collapse to their first place."""
    spark = assets.sparkSession
    places = spark.createDataFrame([(n, i) for n, i in enumerate(dict.fromkeys(ids))], "pos long, id long")
    return assets.join(F.broadcast(places), "id").orderBy("pos")


@dataclass(frozen=True)
class Filter:
    """A conjunction over catalogue columns; what is None does not filter."""

    day_from: int | None = None
    day_to: int | None = None
    source_id: int | None = None
    is_video: bool | None = None
    is_raw: bool | None = None
    is_screenshot: bool | None = None
    is_live: bool | None = None
    device: str | None = None
    lens: str | None = None
    has_faces: bool | None = None
    persons: tuple[int, ...] = ()

    def is_empty(self) -> bool:
        return not any(v is not None and v != () for v in asdict(self).values())

    def column(self) -> Column:
        tests = [F.lit(True)]
        if self.day_from is not None:
            tests.append(F.col("day") >= self.day_from)
        if self.day_to is not None:
            tests.append(F.col("day") <= self.day_to)
        if self.source_id is not None:
            tests.append(F.col("source_id") == self.source_id)
        for name in ("is_video", "is_raw", "is_screenshot", "is_live"):
            if (want := getattr(self, name)) is not None:
                tests.append(F.col(name) == want)
        for name in ("device", "lens"):
            if (want := getattr(self, name)) is not None:
                tests.append(F.coalesce(F.lower(name).contains(want.lower()), F.lit(False)))
        return reduce(and_, tests)


def filtered(assets: DataFrame, want: Filter, faces: DataFrame | None = None) -> DataFrame:
    """Rows of assets that a filter lets pass; faces are needed where it asks for them."""
    out = assets.where(want.column())
    if want.has_faces is not None:
        found = faces.select(F.col("asset_id").alias("id"))
        out = out.join(found, "id", "left_semi" if want.has_faces else "left_anti")
    if want.persons:
        any_of = faces.where(F.col("person_id").isin(list(want.persons))).select(F.col("asset_id").alias("id"))
        out = out.join(any_of, "id", "left_semi")
    return out


def search(
    assets: DataFrame,
    want: Filter,
    faces: DataFrame | None = None,
    hidden: DataFrame | None = None,
    vectors: DataFrame | None = None,
    query: list[float] | None = None,
    limit: int = 50,
    candidate_cap: int | None = None,
) -> DataFrame:
    """Filter, then (with a query vector) re-rank by cosine: scored rows first, the others in feed order.

    candidate_cap keeps only so many newest rows before the people and vector steps, as a client with a
    latency bound would; None, the default, considers all rows. limit is clamped to 1..500.
    """
    limit = max(1, min(limit, 500))
    out = assets if hidden is None else visible(assets, hidden)
    plain = Filter(**{**asdict(want), "has_faces": None, "persons": ()})
    out = filtered(out, plain)
    if candidate_cap:
        out = out.orderBy(*newest_first()).limit(max(candidate_cap, 50))
    out = filtered(out, Filter(has_faces=want.has_faces, persons=want.persons), faces)
    score = F.lit(None).cast("double")
    if query is not None and vectors is not None:
        out = out.join(vectors.select(F.col("asset_id").alias("id"), "vec"), "id", "left")
        score = F.when(F.col("vec").isNotNull(), S.cosine(F.col("vec"), F.array(*map(F.lit, query))))
    out = out.withColumn("score", score)
    return out.orderBy(F.col("score").desc_nulls_last(), *newest_first()).limit(limit)


RULE = (
    "date_from date, date_to date, source_id long, is_video boolean, is_raw boolean, is_screenshot boolean, "
    "is_live boolean, device string, lens string, has_faces boolean, persons array<long>"
)


def compile_rule(rule: dict) -> Filter:
    """A saved rule (dates as ISO text) as a filter. One open end of a date range stays open; an empty rule is an error."""
    day = lambda v: (date.fromisoformat(v) - date(1970, 1, 1)).days if v else None
    rest = {k: v for k, v in rule.items() if k not in ("date_from", "date_to", "persons") and v is not None}
    out = Filter(day_from=day(rule.get("date_from")), day_to=day(rule.get("date_to")), persons=tuple(rule.get("persons") or ()), **rest)
    if out.is_empty():
        raise ValueError("the rule has no clause")
    return out


def snapshot(collection_id: int, hits: DataFrame, at: int) -> DataFrame:
    """The materialised members of a saved rule: (collection_id, asset_id, snapshot_at). Written over the old ones."""
    return hits.select(F.lit(collection_id).cast("long").alias("collection_id"), F.col("id").alias("asset_id"), F.lit(at).cast("long").alias("snapshot_at"))


# people -------------------------------------------------------------------------------------------------------------


def best_face(faces: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The face of best quality of each person, faces without quality last, then by the order columns."""
    w = Window.partitionBy("person_id").orderBy(F.col("quality").desc_nulls_last(), *order)
    return faces.where("person_id is not null").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def people(persons: DataFrame, faces: DataFrame, order: tuple[str, ...], with_hidden: bool = False) -> DataFrame:
    """(id, name, hidden, n_faces, cover): people with faces, or hidden ones where those are asked for.

    The cover is a maximum of a struct, so it is combined map-side and no person's faces are sorted in one place.
    """
    key = F.struct(
        F.col("quality").isNotNull().alias("some"), "quality", *((-F.col(c)).alias(c) for c in order), F.col("asset_id").alias("cover")
    )
    per = faces.where("person_id is not null").groupBy("person_id").agg(F.count("*").alias("n_faces"), F.max(key).alias("best"))
    out = persons.join(per, persons["id"] == per["person_id"], "left")
    keep = F.col("n_faces").isNotNull() & ~F.col("hidden") if not with_hidden else F.col("n_faces").isNotNull() | F.col("hidden")
    return out.where(keep).select("id", "name", "hidden", F.coalesce("n_faces", F.lit(0)).alias("n_faces"), F.col("best.cover").alias("cover"))


def merge_persons(faces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Faces of mapping's `old` persons belong to `new` afterwards (null: to nobody)."""
    m = mapping.select(F.col("old").alias("person_id"), "new", F.lit(True).alias("hit"))
    out = faces.join(m, "person_id", "left")
    return out.withColumn("person_id", F.when(F.col("hit"), F.col("new")).otherwise(F.col("person_id"))).select(*faces.columns)


# writes as transforms -----------------------------------------------------------------------------------------------


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """incoming's first row of each key that existing does not hold: insert or ignore."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = incoming.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return first.join(existing.select(*keys), keys, "left_anti")


def merge_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], at: str, op: str = "op") -> DataFrame:
    """The latest row of each key over both tables; a latest row with op 'delete' removes the key.

    The latest row is a maximum over structs, combined map-side: a key with very many changes costs a row a task.
    """
    names = existing.columns
    old = existing.withColumn(op, F.lit("upsert")).withColumn("__new", F.lit(0))
    both = old.unionByName(incoming.withColumn("__new", F.lit(1)).select(*names, op, "__new"))
    rest = [c for c in [*names, op] if c not in (*keys, at)]
    latest = both.groupBy(*keys).agg(F.max(F.struct(at, "__new", *rest)).alias("l"))
    return latest.where(F.col(f"l.{op}") != "delete").select(*(c if c in keys else F.col(f"l.{c}").alias(c) for c in names))
