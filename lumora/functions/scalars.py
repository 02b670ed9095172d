"""Column functions: days and labels, text, geography, vectors, boxes, bits. All stay inside the JVM."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions import cities

KM = 6371.0


def each(values: Column, use) -> Column:
    """use(value) with value computed once: a bound variable is not copied into its places of use."""
    return F.get(F.transform(F.array(values), use), F.lit(0))


# days ---------------------------------------------------------------------------------------------------------------


def epoch_day(ts: Column) -> Column:
    """Days since 1970 of a timestamp, truncated toward zero (a moment before 1970 belongs to the next day)."""
    return F.expr("cast(0 as bigint)") + (F.unix_timestamp(ts) / 86400).cast("long")


def day_date(day: Column) -> Column:
    """Date of an epoch day; days before 1970 count as its first."""
    return F.date_from_unix_date(F.greatest(day, F.lit(0)).cast("int"))


def onto_year(date: Column, year: int) -> Column:
    """The same month and day in another year; null where that year has no such day."""
    return F.try_to_date(F.concat(F.lit(f"{year:04d}-"), F.date_format(date, "MM-dd")), "yyyy-MM-dd")


def circular_days(a: Column, b: Column) -> Column:
    """Distance of two days of the year around a circle of 365."""
    d = F.abs(F.dayofyear(a) - F.dayofyear(b))
    return F.least(d, 365 - d)


def range_label(start: Column, end: Column) -> Column:
    """`Jan 3, 2024`, `Jan 3 → Jan 10, 2024` or, over years, `Dec 30, 2023 → Jan 2, 2024`."""
    full, short = "MMM d, yyyy", "MMM d"
    left = F.when(F.year(start) == F.year(end), F.date_format(start, short)).otherwise(F.date_format(start, full))
    return F.when(start == end, F.date_format(start, full)).otherwise(F.concat(left, F.lit(" → "), F.date_format(end, full)))


def zoom_label(day: Column, zoom: str) -> Column:
    """Header over a feed by year, month or day; `Undated` without a day."""
    pattern = {"year": "yyyy", "month": "MMMM yyyy", "day": "MMM d, yyyy"}[zoom]
    return F.coalesce(F.date_format(F.date_from_unix_date(day.cast("int")), pattern), F.lit("Undated"))


def first_time(*texts: Column) -> Column:
    """The first text that reads as a camera time, `yyyy:MM:dd HH:mm:ss` or with dashes."""
    ways = [F.try_to_timestamp(t, F.lit(p)) for t in texts for p in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")]
    return F.coalesce(*ways)


# text ---------------------------------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, in no order. Null text: null."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def tokenize(text: Column) -> Column:
    """Sorted distinct lower-case runs of letters and digits. Null text: null."""
    return F.sort_array(words(text))


def search_key(master: str, context: str = "text-search") -> Column:
    return F.sha2(F.concat(F.lit(context), F.lit(master)), 256)


def blind(key: Column | str, token: Column, label: str = "tok") -> Column:
    """32 keyed hex digits that stand for a token."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.substring(F.sha2(F.concat(key, F.lit(label), F.lit("\x1f"), token), 256), 1, 32)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def between_tags(body: Column, tag: str) -> Column:
    """Trimmed text of the first element of that name; null if there is none."""
    found = F.regexp_extract(body, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.nullif(F.trim(found), F.lit(""))


def attribute(body: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(body, rf"""\b{name}\s*=\s*"([^"]*)\"""", 1), F.lit(""))


def items(body: Column, tag: str) -> Column:
    """Trimmed texts of all elements of that name."""
    return F.transform(F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1), lambda x: F.trim(x))


# fixed values: the five entities, in the order in which they are undone
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def decode_entities(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def encode_entities(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


# geography ----------------------------------------------------------------------------------------------------------


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * KM)


CITY = "array<struct<lat:double,lon:double,city:string,region:string,country:string,people:int>>"
CELL = 5  # degrees; half the diagonal of a cell is 394 km at most


def _cities(rows) -> str:
    return json.dumps([dict(zip(("lat", "lon", "city", "region", "country", "people"), r)) for r in rows])


def city_cell(lat: Column, lon: Column) -> Column:
    return F.floor(lat / CELL) * 1000 + F.floor(lon / CELL)


def cities_by_cell(spark, max_km: float = 500.0) -> DataFrame:
    """(cell, near): for every cell of CELL degrees its cities in the order of the table, without those too far to matter.

    A city more than ten kilometres beyond max_km never takes over from one within it, and one within it always takes over.
    A few thousand rows, whatever the data.
    """

    def km(a: float, b: float, c: float, d: float) -> float:
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * KM * math.asin(math.sqrt(min(1.0, h)))

    rows = list(cities.rows())
    out = []
    for y in range(-90 // CELL, 90 // CELL + 1):
        for x in range(-180 // CELL, 180 // CELL + 1):
            mid = (y + 0.5) * CELL, (x + 0.5) * CELL
            out.append((y * 1000 + x, _cities(r for r in rows if km(*mid, r[0], r[1]) <= max_km + 10 + 400)))
    return spark.createDataFrame(out, "cell long, near string").select("cell", F.from_json("near", CITY).alias("near"))


def nearest_city(lat: Column, lon: Column, max_km: float = 500.0, table: Column | None = None) -> Column:
    """struct(city, region, country) by an ordered fold over the city table, or null beyond max_km.

    A later city takes over where it is half a kilometre nearer, or where it has more people and is at most ten
    kilometres farther. The order of the table matters, so this is not a minimum. table: the cities of the place's cell, if
    they were looked up; null means all.
    """
    every = F.from_json(F.lit(_cities(cities.rows())), CITY)
    table = every if table is None else F.coalesce(table, every)
    none = "struct<d:double,city:string,region:string,country:string,people:int>"
    start = F.lit(None).cast(none)

    def step(best: Column, c: Column) -> Column:
        def choose(d: Column) -> Column:
            better = best.isNull() | (d < best["d"] - 0.5) | ((d < best["d"] + 10) & (c["people"] > best["people"]))
            taken = F.struct(
                d.alias("d"), c["city"].alias("city"), c["region"].alias("region"), c["country"].alias("country"), c["people"].alias("people")
            )
            return F.when(better, taken).otherwise(best)

        return each(haversine_km(lat, lon, c["lat"], c["lon"]), choose).cast(none)

    best = F.aggregate(table, start, step)
    near = each(best, lambda b: F.when(b["d"] <= max_km, F.struct(b["city"].alias("city"), b["region"].alias("region"), b["country"].alias("country"))))
    return F.when(lat.isNotNull() & lon.isNotNull(), near)


def dms_to_degrees(d: Column, m: Column, s: Column) -> Column:
    return d + m / 60 + s / 3600


def parse_gps(text: Column) -> Column:
    """`47,37.45N` as signed degrees; null if it reads otherwise."""
    at = r"^\s*(\d+),(\d+(?:\.\d+)?)([NSEW])\s*$"
    value = F.regexp_extract(text, at, 1).try_cast("double") + F.regexp_extract(text, at, 2).try_cast("double") / 60
    return F.when(F.regexp_extract(text, at, 3).isin("S", "W"), -value).otherwise(value)


def format_gps(degrees: Column, positive: str, negative: str) -> Column:
    whole = F.floor(F.abs(degrees))
    return F.concat(
        whole.cast("string"), F.lit(","), F.format_string("%.4f", (F.abs(degrees) - whole) * 60), F.when(degrees < 0, negative).otherwise(positive)
    )


# vectors and bits ---------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; 0 where lengths differ."""
    whole = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), whole).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm < 1e-12, 0.0).otherwise(dot(a, b) / norm)


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return each(F.sqrt(dot(a, a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>")))


def sign_hash(a: Column) -> Column:
    """64 bits from the signs of the first 64 components, the first in the highest place."""
    bits = F.transform(F.slice(a, 1, 64), lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))


def difference_hash(gray: Column) -> Column:
    """64 bits of a 9 by 8 grey raster in rows: a pixel brighter than its right neighbour, first bit highest."""
    at = F.array(*(F.lit(i) for i in range(72) if i % 9 < 8))
    bit = lambda g, i: F.when(F.get(g, i) > F.get(g, i + 1), 1).otherwise(0).cast("long")
    return each(gray, lambda g: F.aggregate(at, F.lit(0).cast("long"), lambda s, i: F.shiftleft(s, 1).bitwiseOR(bit(g, i))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# boxes --------------------------------------------------------------------------------------------------------------


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes with x1, y1, x2, y2; 0 where the union is empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda c: F.greatest(c["x2"] - c["x1"], F.lit(0.0)) * F.greatest(c["y2"] - c["y1"], F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union <= 0, 0.0).otherwise(w * h / union)


def suppressed(boxes: Column, threshold: float) -> Column:
    """Greedy suppression over boxes already in score order: kept while they overlap no kept one by more."""
    return F.aggregate(
        boxes,
        F.slice(boxes, 1, 0),
        lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > threshold), kept).otherwise(F.concat(kept, F.array(b))),
    )


def letterbox(w: Column, h: Column, side: int) -> Column:
    """struct(scale, pad_x, pad_y) that fits a picture into a square."""
    scale = F.lit(float(side)) / F.greatest(w, h)
    return F.struct(scale.alias("scale"), ((side - w * scale) / 2).alias("pad_x"), ((side - h * scale) / 2).alias("pad_y"))


def crop_square(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float = 0.25) -> Column:
    """struct(x, y, side) of a padded square around a box, inside the picture."""
    side = F.least(F.greatest(w, h) * (1 + 2 * pad), width, height)
    left = F.least(F.greatest(x + w / 2 - side / 2, F.lit(0.0)), width - side)
    top = F.least(F.greatest(y + h / 2 - side / 2, F.lit(0.0)), height - side)
    return F.struct(F.round(left).alias("x"), F.round(top).alias("y"), F.round(side).alias("side"))


def marker_size(n: Column) -> Column:
    return F.when(n <= 1, 18.0).when(n < 10, 36.0).otherwise(F.least(F.lit(56.0), 36 + 8 * F.log10(n)))


def register(spark) -> None:
    """The scalar functions as SQL functions, for queries written as text."""
    spark.sql("create or replace temporary function hamming64(a bigint, b bigint) returns int return bit_count(a ^ b)")
    spark.sql(
        "create or replace temporary function haversine_km(lat1 double, lon1 double, lat2 double, lon2 double) returns double "
        "return asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))) * 12742.0"
    )
    spark.sql(
        "create or replace temporary function tokenize(t string) returns array<string> "
        r"return array_sort(array_distinct(filter(split(lower(t), '[^\\p{L}\\p{N}]+'), x -> x <> '')))"
    )
