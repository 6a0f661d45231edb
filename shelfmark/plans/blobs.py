"""Media files put together by Spark from columns of the driver's tables, for the queries that read bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(text: str) -> Column:
    """Bytes written in hex, blanks left out."""
    return F.unhex(F.lit(text.replace(" ", "")))


def big(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def little(value: Column, size: int) -> Column:
    h = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))]))


def text(value: Column | str) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("binary")


def exif_block(is_big: Column, date_tag: Column, date: Column, lat: list[Column], south: Column, lon: list[Column], west: Column) -> Column:
    """A TIFF block in either byte order with a date (19 characters) and a position, in hundredths of each part."""

    def u(value: Column | int, size: int) -> Column:
        value = F.lit(value) if isinstance(value, int) else value
        return F.when(is_big, big(value, size)).otherwise(little(value, size))

    def entry(tag: Column | int, kind: int, count: int, value: Column) -> Column:
        return F.concat(u(tag, 2), u(kind, 2), u(count, 4), value)

    top = F.concat(u(2, 2), entry(date_tag, 2, 20, u(38, 4)), entry(0x8825, 4, 1, u(58, 4)), u(0, 4))
    side = lambda flag, yes, no: F.concat(F.when(flag, text(yes)).otherwise(text(no)), fixed("00 00 00"))
    gps = F.concat(u(4, 2), entry(1, 2, 2, side(south, "S", "N")), entry(2, 5, 3, u(112, 4)), entry(3, 2, 2, side(west, "W", "E")), entry(4, 5, 3, u(136, 4)), u(0, 4))
    parts = [F.concat(u(v, 4), u(100, 4)) for v in [*lat, *lon]]
    return F.concat(F.when(is_big, text("MM")).otherwise(text("II")), u(42, 2), u(8, 4), top, text(date), fixed("00"), gps, *parts)


def jpeg(width: Column, height: Column, block: Column) -> Column:
    """A JPEG of 160 bytes of EXIF, a frame header, a scan of two bytes and its end."""
    app = F.concat(fixed("FF E1"), big(F.octet_length(block) + 8, 2), fixed("45 78 69 66 00 00"), block)
    frame = F.concat(fixed("FF C0 00 0B 08"), big(height, 2), big(width, 2), fixed("01 01 11 00"))
    return F.concat(fixed("FF D8"), app, frame, fixed("FF DA 00 08 01 01 00 00 3F 00"), fixed("12 34"), fixed("FF D9"))


def png(grey: Column) -> Column:
    """A PNG of one grey pixel: its chunks with their checksums."""

    def chunk(name: str, body: Column) -> Column:
        named = F.concat(text(name), body)
        return F.concat(big(F.octet_length(body), 4), named, big(F.crc32(named), 4))

    # One stored block of two bytes (no filter, the pixel), with its Adler-32.
    stream = F.concat(fixed("78 01 01 02 00 FD FF 00"), big(grey, 1), big(grey + 2, 2), big(grey + 1, 2))
    return F.concat(fixed("89 50 4E 47 0D 0A 1A 0A"), chunk("IHDR", fixed("00000001 00000001 08 00 00 00 00")), chunk("IDAT", stream), chunk("IEND", fixed("")))


def gif(delays: Column) -> Column:
    """A GIF of a frame for each delay (hundredths of a second), in order."""
    # The hex of a frame: its delay, the picture of one pixel, its data.
    frame = lambda d: F.concat(F.lit("21F90400"), F.hex(little(d, 2)), F.lit("00002C0000000001000100000202440100"))
    return F.concat(text("GIF89a"), fixed("0100 0100 00 00 00"), F.unhex(F.array_join(F.transform(delays, frame), "")), fixed("3B"))
