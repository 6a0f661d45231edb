"""Media files read from their bytes in one pass: structure, size, frames and their delays, capture time, position.

``inspect`` walks each file once, in Arrow batches, and gives a row of plain facts; dates, degrees, frame times and the
broken ones are column expressions over those rows, so nothing reads a file twice.  A file that its walk finds broken has
an ``error`` and keeps what was read before it; a broken EXIF block only gives nulls, as it does not break the picture.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dms_to_degrees, exif_timestamp

#: EXIF tags (fixed values): capture dates by priority, the position directory, and in it latitude and longitude.
DATE_TAGS, GPS_DIRECTORY, EXIF_DIRECTORY = (36867, 36868, 306), 0x8825, 0x8769
GPS_LAT, GPS_LON = (1, 2), (3, 4)
#: Bytes of an element of each TIFF type.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
PNG_START, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
FACTS = "kind string, width long, height long, delays array<long>, dates array<string>, lat array<double>, lat_ref string, lon array<double>, lon_ref string, error string"
NAMES = [x.split()[0] for x in FACTS.split(", ")]


class Broken(Exception):
    """The file ends early or contradicts itself."""


def part(data: bytes, at: int, size: int) -> bytes:
    if at < 0 or size < 0 or at + size > len(data):
        raise Broken("file ends early")
    return data[at : at + size]


def number(order: str, code: str, data: bytes, at: int) -> int:
    return struct.unpack(order + code, part(data, at, struct.calcsize(code)))[0]


def directory(tiff: bytes, order: str, at: int) -> dict[int, object]:
    """Tags of one TIFF directory: texts, numbers, or lists of them."""
    out = {}
    for k in range(number(order, "H", tiff, at)):
        tag, kind, count = struct.unpack(order + "HHI", part(tiff, entry := at + 2 + 12 * k, 8))
        size = TYPE_BYTES.get(kind, 0) * count
        if size:
            value = part(tiff, entry + 8 if size <= 4 else number(order, "I", tiff, entry + 8), size)
            out[tag] = values(value, order, kind, count)
    return out


def values(value: bytes, order: str, kind: int, count: int) -> object:
    if kind in (2, 7):
        return value.split(b"\0")[0].decode("latin-1")
    if kind in (5, 10):
        flat = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", value)
        return [a / b if b else None for a, b in zip(flat[::2], flat[1::2], strict=True)]
    found = struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 9: 'i'}[kind]}", value)
    return found[0] if count == 1 else list(found)


def exif(tiff: bytes, facts: dict, deep: bool = False) -> None:
    """Dates of the first directory (``deep``: of the EXIF directory too) and the position; nothing from a broken block."""
    try:
        order = {b"II": "<", b"MM": ">"}[part(tiff, 0, 2)]
        top = directory(tiff, order, number(order, "I", tiff, 4))
        dates = dict(top)
        if deep and isinstance(top.get(EXIF_DIRECTORY), int):
            dates |= directory(tiff, order, top[EXIF_DIRECTORY])
        gps = directory(tiff, order, top[GPS_DIRECTORY]) if isinstance(top.get(GPS_DIRECTORY), int) else {}
    except (Broken, KeyError, struct.error):
        return
    facts["dates"] = [dates[t] for t in DATE_TAGS if isinstance(dates.get(t), str) and dates[t]]
    for name, (ref, place) in (("lat", GPS_LAT), ("lon", GPS_LON)):
        if isinstance(gps.get(place), list) and None not in gps[place]:
            facts[name] = [float(v) for v in gps[place]]
            facts[f"{name}_ref"] = gps.get(ref) if isinstance(gps.get(ref), str) else None


def png(data: bytes, facts: dict) -> None:
    """Chunks with their checksums; the pixel stream must unpack to the picture's size."""
    at, rows, unpacker, got = len(PNG_START), None, zlib.decompressobj(), 0
    while True:
        size, name = number(">", "I", data, at), part(data, at + 4, 4)
        body = part(data, at + 8, size)
        if zlib.crc32(name + body) != number(">", "I", data, at + 8 + size):
            raise Broken(f"{name.decode('latin-1')}: wrong checksum")
        at += 12 + size
        if name == b"IHDR":
            facts["width"], facts["height"], depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part(body, 0, 13))
            rows = None if interlaced else facts["height"] * (1 + (facts["width"] * depth * CHANNELS.get(colour, 1) + 7) // 8)
        elif name == b"IDAT":
            try:
                piece = unpacker.decompress(body, 1 << 20)
                while piece:
                    got += len(piece)
                    piece = unpacker.decompress(unpacker.unconsumed_tail, 1 << 20)
            except zlib.error:
                raise Broken("IDAT: damaged pixels") from None
        elif name == b"eXIf":
            exif(body, facts)
        elif name == b"fcTL":
            top, below = struct.unpack(">HH", part(body, 20, 4))
            facts["delays"].append(1000 * top // (below or 100))
        elif name == b"IEND":
            break
    if facts["width"] is None or not unpacker.eof or (rows is not None and got != rows):
        raise Broken("IDAT: too few pixels" if facts["width"] is not None else "no IHDR")


def jpeg(data: bytes, facts: dict) -> None:
    """Segments up to the scan, then its end mark."""
    at = 2
    while True:
        if part(data, at, 1) != b"\xff":
            raise Broken("no marker where one is due")
        mark = data[at + 1] if at + 1 < len(data) else 0
        if mark == 0xFF:
            at += 1
            continue
        size = number(">", "H", data, at + 2)
        body = part(data, at + 4, size - 2)
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            facts["height"], facts["width"] = struct.unpack(">HH", part(body, 1, 4))
        elif mark == 0xE1 and body[:6] == b"Exif\0\0":
            exif(body[6:], facts)
        at += 2 + size
        if mark == 0xDA:
            break
    if facts["width"] is None:
        raise Broken("no frame header")
    if data.find(b"\xff\xd9", at) < 0:
        raise Broken("file ends early")


def gif(data: bytes, facts: dict) -> None:
    """Blocks; a frame has the delay of the control block before it."""

    def after_blocks(at: int) -> int:
        while size := part(data, at, 1)[0]:
            part(data, at + 1, size)
            at += 1 + size
        return at + 1

    facts["width"], facts["height"], flags = struct.unpack("<HHB", part(data, 6, 5))
    at, delay = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0
    while (kind := part(data, at, 1)[0]) != 0x3B:
        if kind == 0x21:
            if part(data, at + 1, 1)[0] == 0xF9:
                delay = 10 * number("<", "H", data, at + 4)
            at = after_blocks(at + 2)
        elif kind == 0x2C:
            local = part(data, at + 9, 1)[0]
            at = after_blocks(at + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
            facts["delays"].append(delay)
            delay = 0
        else:
            raise Broken("unknown block")
    if not facts["delays"]:
        raise Broken("no frame")


def webp(data: bytes, facts: dict) -> None:
    end = 8 + number("<", "I", data, 4)
    part(data, 0, end)
    at, pixels = 12, False
    while at + 8 <= end:
        name, size = data[at : at + 4], number("<", "I", data, at + 4)
        body = part(data, at + 8, size)
        pixels |= name in (b"VP8 ", b"VP8L", b"ANMF")
        if name == b"VP8X":
            facts["width"], facts["height"] = (1 + int.from_bytes(part(body, k, 3), "little") for k in (4, 7))
        elif name == b"ANMF":
            facts["delays"].append(int.from_bytes(part(body, 12, 3), "little"))
        elif name == b"EXIF":
            exif(body.removeprefix(b"Exif\0\0"), facts)
        at += 8 + size + size % 2
    if not pixels:
        raise Broken("no pixels")


def bmp(data: bytes, facts: dict) -> None:
    facts["width"], height = struct.unpack("<ii", part(data, 18, 8))
    facts["height"] = abs(height)
    part(data, 0, number("<", "I", data, 2))


def tiff(data: bytes, facts: dict) -> None:
    order = "<" if data[:2] == b"II" else ">"
    top = directory(data, order, number(order, "I", data, 4))
    facts["width"], facts["height"] = top.get(256), top.get(257)
    exif(data, facts)
    if not isinstance(facts["width"], int) or not isinstance(facts["height"], int):
        raise Broken("no size")


def video(data: bytes, facts: dict) -> None:
    """Boxes of the top level; the index and the data must both be there whole."""
    at, seen = 0, set()
    while at < len(data):
        size, name, head = number(">", "I", data, at), part(data, at + 4, 4), 8
        if size == 1:
            size, head = number(">", "Q", data, at + 8), 16
        size = len(data) - at if size == 0 else size
        if size < head:
            raise Broken("a box of no size")
        part(data, at, size)
        seen.add(name)
        at += size
    if not {b"moov", b"mdat"} <= seen:
        raise Broken("could not read a frame")


def kind_of(data: bytes) -> tuple[str, Callable[[bytes, dict], None]] | None:
    """By the first bytes, as files are often named wrongly."""
    if data.startswith(PNG_START):
        return "png", png
    if data.startswith(b"\xff\xd8"):
        return "jpeg", jpeg
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", gif
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp", webp
    if data[:2] == b"BM":
        return "bmp", bmp
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff", tiff
    return ("video", video) if data[4:8] in (b"ftyp", b"moov", b"mdat") else None


def facts_of(data: bytes | None) -> dict:
    facts = dict.fromkeys(NAMES) | {"delays": [], "dates": []}
    known = kind_of(data) if data else None
    if known is None:
        return facts | {"error": "unknown format" if data else "empty file"}
    facts["kind"] = known[0]
    try:
        known[1](data, facts)
    except (Broken, struct.error) as e:
        facts["error"] = str(e)
    return facts


def inspect(files: DataFrame, content: str = "content") -> DataFrame:
    """The columns of the files, but for their content, with the facts of each: one walk over the bytes.

    A null or empty content is an ``empty file``.
    """
    own = [c for c in files.columns if c != content]
    schema = ", ".join(f"`{c}` {dict(files.dtypes)[c]}" for c in own)
    kinds = {"kind": pa.string(), "error": pa.string(), "lat_ref": pa.string(), "lon_ref": pa.string(), "delays": pa.list_(pa.int64()), "dates": pa.list_(pa.string()), "lat": pa.list_(pa.float64()), "lon": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [facts_of(None if x is None else x.as_py()) for x in batch.column(content)]
            facts = [pa.array([f[c] for f in found], kinds.get(c, pa.int64())) for c in NAMES]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *facts], [*own, *NAMES])

    return files.select(*own, content).mapInArrow(run, f"{schema}, {FACTS}" if own else FACTS)


def taken_at() -> Column:
    """Unix seconds of the first capture date that can be read."""
    return F.get(F.filter(F.transform("dates", exif_timestamp), lambda t: t.isNotNull()), F.lit(0))


def latitude() -> Column:
    return dms_to_degrees(F.col("lat"), F.col("lat_ref"))


def longitude() -> Column:
    return dms_to_degrees(F.col("lon"), F.col("lon_ref"))


def frame_count() -> Column:
    """Frames of an animation; 1 for any other picture, null for a broken one."""
    return F.when(F.col("error").isNull(), F.greatest(F.lit(1), F.size("delays")))


def frames(inspected: DataFrame, *keep: str) -> DataFrame:
    """(keep, frame_index, time_ms) of whole files: a row per frame, shown after the delays of the frames before it."""
    delays = F.when(F.size("delays") > 0, F.col("delays")).otherwise(F.array(F.lit(0).cast("long")))
    whole = inspected.where("error IS NULL").select(*keep, delays.alias("d"), F.posexplode(delays).alias("frame_index", "delay"))
    before = F.aggregate(F.slice("d", 1, F.col("frame_index")), F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.select(*keep, "frame_index", before.alias("time_ms"))


def mark_broken(files: DataFrame, inspected: DataFrame, now: Column) -> DataFrame:
    """Files with ``broken`` set to ``now`` where a content of that checksum has an error; others stay as they are."""
    bad = inspected.where("error IS NOT NULL").select("checksum").distinct().withColumn("__bad", F.lit(True))
    out = files.join(bad, "checksum", "left").withColumn("broken", F.when(F.col("__bad"), now).otherwise(F.col("broken")))
    return out.select(*files.columns)
