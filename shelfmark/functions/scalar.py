"""Scalar functions, all as column expressions."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Words that a class query ignores (fixed values).
STOP_WORDS = ["a", "an", "the", "at", "in", "on", "of", "with", "and", "or", "to", "is", "are", "for", "by", "from"]
MIN_TILE_PX = 8
TILE_GRIDS = (2, 3)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def query_tokens(query: Column) -> Column:
    """Lower-cased words without stop words and single characters."""
    return F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def slugify(label: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.lit("tag")).otherwise(slug)


def fuzzy_score(query: Column, text: Column) -> Column:
    """Place of the first character plus a tenth of the spread of a subsequence match; null without one."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        # A match ends at ``at`` (1-based); the next character is sought after it.
        found = F.position(c, lowered, acc["at"] + 1)
        return F.struct(
            F.when(acc["ok"] & (found > 0), found).otherwise(acc["at"]).alias("at"),
            F.when(acc["ok"] & (acc["first"] == 0) & (found > 0), found).otherwise(acc["first"]).alias("first"),
            (acc["ok"] & (found > 0)).alias("ok"),
        )

    letters = F.filter(F.split(F.lower(query), ""), lambda c: c != "")
    out = F.aggregate(letters, start, step, lambda acc: F.when(acc["ok"], (acc["first"] - 1) + (acc["at"] - acc["first"]) * 0.1))
    return F.when(query == "", F.lit(0.0)).otherwise(out)


def sort_token(text: Column) -> Column:
    """struct(field, direction) of a token like ``age:desc``; null fields without one."""
    pattern = r"(?i)\b(age|date|added|modified|name|filename|favorites|distance)\s*:\s*(asc|desc)\b"
    field = F.lower(F.regexp_extract(text, pattern, 1))
    alias = F.when(field == "date", "added").when(field == "name", "filename").otherwise(field)
    none = F.lit(None).cast("string")
    return F.when(field == "", F.struct(none.alias("field"), none.alias("direction"))).otherwise(F.struct(alias.alias("field"), F.lower(F.regexp_extract(text, pattern, 2)).alias("direction")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(d_lat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon / 2), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def dms_to_degrees(dms: Column, ref: Column) -> Column:
    """(degrees, minutes, seconds) with N/S/E/W; null unless there are three numbers."""
    value = dms[0] + dms[1] / 60 + dms[2] / 3600
    return F.when(F.size(dms) == 3, F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value))


def exif_timestamp(raw: Column) -> Column:
    """Unix seconds of ``yyyy:MM:dd HH:mm:ss`` in the session's time zone; null if malformed."""
    return F.unix_timestamp(F.try_to_timestamp(raw, F.lit("yyyy:MM:dd HH:mm:ss")))


def xxh64(content: Column) -> Column:
    """XXH64 with seed 0 of bytes, as 16 hex digits; null for null.  Spark's own expression, which SQL only offers with seed 42."""
    jvm = SparkContext._active_spark_context._jvm
    bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
    hashed = jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(jvm.PythonUtils.toSeq([bridge.expression(content._jc)]), 0)
    return F.when(content.isNotNull(), F.lpad(F.lower(F.hex(Column(bridge.column(hashed)))), 16, "0"))


def containment(face: Column, body: Column) -> Column:
    """Share of the face's box inside the body's; boxes are structs x1, y1, x2, y2."""
    width = F.least(face["x2"], body["x2"]) - F.greatest(face["x1"], body["x1"])
    height = F.least(face["y2"], body["y2"]) - F.greatest(face["y1"], body["y1"])
    area = F.greatest(F.lit(1e-6), (face["x2"] - face["x1"]) * (face["y2"] - face["y1"]))
    return F.when((width > 0) & (height > 0), width * height / area).otherwise(0.0)


def tiles(width: Column, height: Column, min_px: int = MIN_TILE_PX, grids: tuple[int, ...] = TILE_GRIDS) -> Column:
    """Array of structs x1, y1, x2, y2: the whole image, then half-overlapping grids; rounded, clamped, distinct, in order."""
    w, h = width.cast("double"), height.cast("double")
    raw = [(F.lit(0.0), F.lit(0.0), w, h)]
    for n in grids:
        for row in range(n):
            for col in range(n):
                x, y = w * col / (n + 1), h * row / (n + 1)
                raw.append((x, y, x + w * 2 / (n + 1), y + h * 2 / (n + 1)))

    def pixel(v: Column, top: Column) -> Column:
        return F.greatest(F.lit(0), F.least(top.cast("int"), F.bround(v, 0).cast("int")))

    boxes = F.array(*[F.struct(pixel(a, w).alias("x1"), pixel(b, h).alias("y1"), pixel(c, w).alias("x2"), pixel(d, h).alias("y2")) for a, b, c, d in raw])
    return F.array_distinct(F.filter(boxes, lambda t: (t["x2"] - t["x1"] >= min_px) & (t["y2"] - t["y1"] >= min_px)))


def parse_box(text: Column) -> Column:
    """struct of a JSON box ``[x1, y1, x2, y2]``; null for ``[]`` and malformed text."""
    v = F.from_json(text, "array<double>")
    return F.when(F.size(v) == 4, F.struct(v[0].alias("x1"), v[1].alias("y1"), v[2].alias("x2"), v[3].alias("y2")))


def yolo_line(cls: Column, box: Column, width: Column, height: Column) -> Column:
    """``class cx cy w h`` in shares of the image, six decimals, halves to the even digit."""
    shares = [(box["x1"] + box["x2"]) / 2 / width, (box["y1"] + box["y2"]) / 2 / height, (box["x2"] - box["x1"]) / width, (box["y2"] - box["y1"]) / height]
    return F.format_string("%s %.6f %.6f %.6f %.6f", cls.cast("string"), *[F.bround(x, 6) for x in shares])


def parse_face_ref(ref: Column) -> Column:
    """struct(kind, id) of ``auto:<id>`` or ``manual:<id>``; null otherwise."""
    kind, number = F.regexp_extract(ref, "^(auto|manual):([0-9]+)$", 1), F.regexp_extract(ref, "^(auto|manual):([0-9]+)$", 2)
    return F.when(kind != "", F.struct(kind.alias("kind"), F.try_to_number(number, F.lit("999999999999999999")).cast("long").alias("id")))


def next_placeholder(names: DataFrame, prefix: str = "Unnamed ", column: str = "identity") -> DataFrame:
    """One row ``name``: the prefix with the least positive number not in use (1, or one above a used one)."""
    used = names.select(F.regexp_extract(column, f"^{prefix}([0-9]+)$", 1).alias("n")).where("n <> ''").select(F.col("n").cast("long").alias("n")).where("n > 0").distinct()
    one = names.sparkSession.range(1).select(F.lit(1).cast("long").alias("n"))
    free = used.select((F.col("n") + 1).alias("n")).union(one).join(used, "n", "left_anti")
    return free.agg(F.concat(F.lit(prefix), F.min("n").cast("string")).alias("name"))


def merge_vocabulary(terms: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Terms (pos, term) without case repeats, first spelling kept, minus the excluded."""
    keyed = terms.where(F.trim("term") != "").withColumn("key", F.lower(F.trim("term")))
    if excluded is not None:
        keyed = keyed.join(excluded.select(F.lower(F.trim("term")).alias("key")), "key", "left_anti")
    return keyed.groupBy("key").agg(F.min(F.struct("pos", F.trim("term").alias("term"))).alias("b")).select(F.col("b.pos").alias("pos"), F.col("b.term").alias("term"))


def grid_cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")
