"""EXIF from bytes: the directories of TIFF data, alone or inside JPEG or PNG, as one struct a file that never fails."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: tag numbers by directory, and bytes a value of each type
MAIN = {0x0100: "ImageWidth", 0x0101: "ImageLength", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x8769: "ExifIFD", 0x8825: "GPSInfo", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "PhotographicSensitivity", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x920A: "FocalLength", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA434: "LensModel"}
POSITION = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}

STRUCT = "device string, lens string, width long, height long, taken_s long, lat double, lon double, alt double, fields array<struct<ifd:int,tag:string,value:string>>"


def _part(data: bytes, at: int, size: int) -> bytes:
    if at < 0 or size < 0 or at + size > len(data):
        raise LookupError("beyond the end")
    return data[at : at + size]


def _values(data: bytes, order: str, kind: int, count: int, slot: bytes):
    """A field's values: text for type 2, pairs for rationals, numbers or bytes for the rest."""
    size = SIZES[kind] * count
    raw = slot[:size] if size <= 4 else _part(data, struct.unpack(order + "I", slot)[0], size)
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace")
    if kind == 7:
        return raw
    if kind in (5, 10):
        whole = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
        return list(zip(whole[::2], whole[1::2]))
    return list(struct.unpack(f"{order}{count}{CODES[kind]}", raw))


def directories(data: bytes) -> list[tuple[int, int, bool, object]]:
    """(ifd, tag, is_position, values) of all readable fields of TIFF data; what is cut off, loops or makes no sense is left out."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        return []
    out, seen, todo = [], set(), [(struct.unpack(order + "I", data[4:8])[0], 0, False)]
    while todo:
        at, ifd, position = todo.pop(0)
        if at in seen or not at:
            continue
        seen.add(at)
        try:
            (many,) = struct.unpack(order + "H", _part(data, at, 2))
        except LookupError:
            continue
        for k in range(many):
            try:
                entry = _part(data, at + 2 + 12 * k, 12)
            except LookupError:
                break
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            try:
                found = _values(data, order, kind, count, entry[8:])
            except (LookupError, struct.error):
                continue
            if tag in (0x8769, 0x8825) and isinstance(found, list) and found and not position:
                todo.insert(0, (found[0], ifd, tag == 0x8825))
            else:
                out.append((ifd, tag, position, found))
        try:
            todo.append((struct.unpack(order + "I", _part(data, at + 2 + 12 * many, 4))[0], ifd + 1, False) if not position and not ifd else (0, 0, False))
        except LookupError:
            pass
    return out


def tiff_in(content: bytes) -> tuple[bytes, int | None, int | None]:
    """The TIFF data inside a file, and the width and height that the picture's own header states."""
    if content[:2] in (b"II", b"MM"):
        return content, None, None
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at, found, size = 8, b"", (None, None)
        while at + 8 <= len(content):
            n, kind = struct.unpack(">I4s", content[at : at + 8])
            body = content[at + 8 : at + 8 + n]
            if kind == b"IHDR" and len(body) >= 8:
                size = struct.unpack(">II", body[:8])
            elif kind == b"eXIf":
                found = body
            at += 12 + n
        return found, *size
    if content[:2] != b"\xff\xd8":
        return b"", None, None
    at, found, size = 2, b"", (None, None)
    while at + 4 <= len(content) and content[at] == 0xFF:
        mark = content[at + 1]
        if mark == 0xFF:  # a fill byte
            at += 1
            continue
        (n,) = struct.unpack(">H", content[at + 2 : at + 4])
        body = content[at + 4 : at + 2 + n]
        if mark == 0xE1 and body[:6] == b"Exif\0\0" and not found:
            found = body[6:]
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            height, width = struct.unpack(">HH", body[1:5])
            size = (width, height)
        elif mark in (0xD9, 0xDA) or n < 2:
            break
        at += 2 + n
    return found, *size


def _shown(found: object) -> str:
    if isinstance(found, str):
        return f'"{found}"'
    if isinstance(found, bytes):
        return "0x" + found[:64].hex()
    return ", ".join(f"{x[0]}/{x[1]}" if isinstance(x, tuple) else str(x) for x in found)


def _ratio(pair: tuple[int, int]) -> float | None:
    return pair[0] / pair[1] if pair[1] else None


def dms_to_decimal(found: object) -> float | None:
    """Degrees from exactly three fractions (degrees, minutes, seconds); null for anything else or a zero divisor."""
    if not isinstance(found, list) or len(found) != 3 or not all(isinstance(x, tuple) for x in found):
        return None
    d, m, s = map(_ratio, found)
    return None if None in (d, m, s) else d + m / 60 + s / 3600


def _moment(text: object) -> int | None:
    for pattern in ("%Y-%m-%d %H:%M:%S", "%Y:%m:%d %H:%M:%S"):
        try:
            return int(datetime.strptime(str(text).strip('"'), pattern).replace(tzinfo=timezone.utc).timestamp())
        except ValueError:
            continue
    return None


def probe(content: bytes | None) -> dict:
    """The struct of one file; fields that are absent or unreadable are null.

    Device and lens lose their quotes, empty ones are null. Width and height are the picture's own, else EXIF's. The original time comes before the file's time, in
    either of two patterns. A position needs both degrees and both references; S and W are negative.
    """
    data, width, height = tiff_in(content or b"")
    fields = directories(data)
    main, place = {}, {}
    for ifd, tag, position, found in fields:
        if ifd == 0:
            (place if position else main).setdefault(tag, found)

    def text(tag: int) -> str | None:
        return (main[tag].strip('"').strip() or None) if isinstance(main.get(tag), str) else None

    def number(*tags: int) -> int | None:
        return next((int(main[t][0]) for t in tags if isinstance(main.get(t), list) and main[t] and isinstance(main[t][0], int)), None)

    lat, lon = dms_to_decimal(place.get(2)), dms_to_decimal(place.get(4))
    if lat is None or lon is None or not isinstance(place.get(1), str) or not isinstance(place.get(3), str):
        lat = lon = None
    else:
        lat, lon = (-lat if "S" in place[1] else lat), (-lon if "W" in place[3] else lon)
    high = place.get(6)
    alt = _ratio(high[0]) if lat is not None and isinstance(high, list) and high and isinstance(high[0], tuple) else None
    taken = _moment(main.get(0x9003))
    return {
        "device": text(0x0110), "lens": text(0xA434), "width": width if width is not None else number(0xA002, 0x0100), "height": height if height is not None else number(0xA003, 0x0101),
        "taken_s": taken if taken is not None else _moment(main.get(0x0132)), "lat": lat, "lon": lon, "alt": alt,
        "fields": [{"ifd": i, "tag": (POSITION if p else MAIN).get(t, f"0x{t:04x}"), "value": _shown(v)} for i, t, p, v in fields],
    }


def probed(files: DataFrame, content: str = "content") -> DataFrame:
    """files with struct `exif` in place of the content column: binary directories are walked in Arrow batches, a file at a time."""
    kept = [c for c in files.columns if c != content]
    inner = "struct<" + ", ".join(x.strip().replace(" ", ":", 1) for x in STRUCT.split(", ")) + ">"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct(
            [("device", pa.string()), ("lens", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("taken_s", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("alt", pa.float64()),
             ("fields", pa.list_(pa.struct([("ifd", pa.int32()), ("tag", pa.string()), ("value", pa.string())])))]
        )
        for b in batches:
            found = pa.array([probe(x.as_py()) for x in b.column(b.num_columns - 1)], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), found], [*kept, "exif"])

    ddl = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)
    out = files.select(*(f"`{c}`" for c in kept), f"`{content}`").mapInArrow(walk, f"{ddl}, exif {inner}")
    return out.withColumn("exif", F.col("exif").withField("taken", F.timestamp_seconds("exif.taken_s")).dropFields("taken_s"))


def written(device=None, lens=None, taken=None, original=None, lat=None, lon=None, alt=None, size=None, own_size=None, big=False) -> bytes:
    """A small JPEG whose EXIF says so: the other direction, for samples and round trips. Seconds of a degree keep four places."""
    order = ">" if big else "<"
    text = lambda s: (2, len(s.encode()) + 1, s.encode() + b"\0")
    long_ = lambda v: (4, 1, struct.pack(order + "I", v))
    ratios = lambda *v: (5, len(v), b"".join(struct.pack(order + "II", *x) for x in v))

    def degrees(v: float):
        parts = round(abs(v) * 3600 * 10_000)
        return ratios((parts // 36_000_000, 1), (parts // 600_000 % 60, 1), (parts % 600_000, 10_000))

    main = {0x0110: device and text(device), 0x0132: taken and text(taken)}
    more = {0x9003: original and text(original), 0xA434: lens is not None and text(lens), 0xA002: size and long_(size[0]), 0xA003: size and long_(size[1])}
    spot = {} if lat is None or lon is None else {1: text("S" if lat < 0 else "N"), 2: degrees(lat), 3: text("W" if lon < 0 else "E"), 4: degrees(lon), 6: alt is not None and ratios((round(alt * 100), 100))}

    def directory(entries: dict, at: int) -> bytes:
        entries = {t: e for t, e in sorted(entries.items()) if e}
        head, tail, free = struct.pack(order + "H", len(entries)), b"", at + 6 + 12 * len(entries)
        for tag, (kind, count, raw) in entries.items():
            slot = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", free + len(tail))
            tail += raw if len(raw) > 4 else b""
            head += struct.pack(order + "HHI", tag, kind, count) + slot
        return head + struct.pack(order + "I", 0) + tail

    first = len(directory(main | {0x8769: long_(0), 0x8825: long_(0)}, 8))
    second = directory(more, 8 + first)
    third = directory(spot, 8 + first + len(second))
    whole = (b"MM" if big else b"II") + struct.pack(order + "HI", 42, 8) + directory(main | {0x8769: long_(8 + first), 0x8825: long_(8 + first + len(second))}, 8) + second + third
    out = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(whole) + 8) + b"Exif\0\0" + whole
    if own_size:
        out += b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, own_size[1], own_size[0], 0)
    return out + b"\xff\xd9"
