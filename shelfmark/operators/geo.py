"""Places: nearest city, distance order, clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import grid_cell, haversine_km

BOX_DEGREES = 0.75
#: Cells of the search on the sphere in degrees, each ``STEP`` times finer than the one before, and the cities that a cell
#: holds on average where it needs no finer ones.
STEP = 4
LEVELS = (10.0, 2.5, 0.625)
FEW_CITIES = 4


def nearest_city(points: DataFrame, cities: DataFrame, box: float = BOX_DEGREES, max_km: float | None = None, exact: bool = False) -> DataFrame:
    """(id, city_id, km): the nearest city inside the box of +-``box`` degrees, km to one decimal; ties to the least id.

    Cells of the box's size turn the range join into an equi-join with the nine cells around a point.  Points whose box
    is empty get the nearest city on the sphere; ``exact`` gives it to all points, box or not.  No row without cities or
    beyond ``max_km``.

    The search is between places: points of one position count once, and of the cities of one position the least id does.
    Points get what their place has found at the end, so that neither a hot place nor many points cost pairs with cities.
    """
    there = "lat IS NOT NULL AND lon IS NOT NULL"
    located = points.where(there).select("id", "lat", "lon")
    places = located.select("lat", "lon").distinct()
    cities = cities.where(there).groupBy("lat", "lon").agg(F.min("id").alias("id"))
    if exact:
        found = _nearest_anywhere(places, cities)
    else:
        near = _in_cells(places, cities, box)
        near = near.where((F.abs(F.col("lat") - F.col("clat")) <= box) & (F.abs(F.col("lon") - F.col("clon")) <= box))
        best = _nearest(near)
        found = best.unionByName(_nearest_anywhere(places.join(best.select("lat", "lon"), ["lat", "lon"], "left_anti"), cities))
    out = located.join(found, ["lat", "lon"]).select("id", "city_id", F.round("km", 1).alias("km"))
    return out if max_km is None else out.where(F.col("km") <= max_km)


def _in_cells(points: DataFrame, cities: DataFrame, size: float) -> DataFrame:
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = points.select("*", F.explode(around).alias("d")).select("lat", "lon", (grid_cell(F.col("lat"), size) + F.col("d.a")).alias("cx"), (grid_cell(F.col("lon"), size) + F.col("d.b")).alias("cy"))
    placed = cities.select(F.col("id").alias("city_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon"), grid_cell(F.col("lat"), size).alias("cx"), grid_cell(F.col("lon"), size).alias("cy"))
    return spread.join(placed, ["cx", "cy"])


def _nearest(pairs: DataFrame) -> DataFrame:
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    return pairs.withColumn("km", km).groupBy("lat", "lon").agg(F.min(F.struct("km", "city_id")).alias("b")).select("lat", "lon", F.col("b.city_id").alias("city_id"), F.col("b.km").alias("km"))


def _nearest_anywhere(points: DataFrame, cities: DataFrame) -> DataFrame:
    """(lat, lon, city_id, km): exact nearest city on the sphere, by cells that are refined where they can still matter.

    For each cell that holds points, those cells of cities stay whose least possible distance is not above the least of all
    greatest possible ones.  That is settled between cells alone: first of ten degrees, at most 648 by 648, then between
    the sixteen parts of a point's cell and those of the cells that stayed, and so on.  In the finest cells points and
    cities meet by equal cells: only the cities that lie hardly further than the nearest one.  Distances between centres are
    great circles, so the seam at 180 degrees and the poles need no case of their own.
    """
    n = cities.count()
    levels = [size for k, size in enumerate(LEVELS) if not k or n > FEW_CITIES * (180 / LEVELS[k - 1]) * (360 / LEVELS[k - 1])]
    placed = points.select("lat", "lon", *_cell("p", levels[-1]))
    held = cities.select(F.col("id").alias("city_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon"), *_cell("g", levels[-1]))
    kept = None
    for size in levels:
        own = [placed.select(*_coarser("p", size, levels[-1])).distinct(), held.select(*_coarser("g", size, levels[-1])).distinct()]
        if kept is None:
            met = own[0].join(F.broadcast(own[1]), F.lit(True))
        else:
            up = lambda c, n: F.floor(F.col(c) / STEP).alias(n)
            parents = kept.select(*[F.col(c).alias(f"up_{c}") for c in ("px", "py", "gx", "gy")])
            of_points = own[0].select("px", "py", up("px", "up_px"), up("py", "up_py")).join(parents, ["up_px", "up_py"])
            met = of_points.join(own[1].select("gx", "gy", up("gx", "up_gx"), up("gy", "up_gy")), ["up_gx", "up_gy"])
        centre = haversine_km((F.col("px") + 0.5) * size, (F.col("py") + 0.5) * size, (F.col("gx") + 0.5) * size, (F.col("gy") + 0.5) * size)
        # From the centre of a cell to its corner it is as far as at the equator at most; twice for each of both cells.
        slack = 4 * 6371.0 * math.radians(size) * math.sqrt(0.5) * 1.01
        least = F.min("centre").over(W.partitionBy("px", "py"))
        kept = met.withColumn("centre", centre).withColumn("least", least).where(F.col("centre") <= F.col("least") + slack).select("px", "py", "gx", "gy")
    around = placed.join(kept, ["px", "py"]).join(held, ["gx", "gy"])
    return _nearest(around)


def _cell(name: str, size: float) -> list[Column]:
    return [grid_cell(F.col("lat"), size).alias(f"{name}x"), grid_cell(F.col("lon"), size).alias(f"{name}y")]


def _coarser(name: str, size: float, finest: float) -> list[Column]:
    """The cell of that size around a finest one."""
    return [F.floor(F.col(f"{name}{axis}") / round(size / finest)).alias(f"{name}{axis}") for axis in "xy"]


def distances(points: DataFrame, lat: float, lon: float) -> DataFrame:
    """Adds km (one decimal) to a target; null without a position."""
    return points.withColumn("km", F.round(haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")), 1))


def by_distance(points: DataFrame, lat: float, lon: float, ascending: bool = True) -> DataFrame:
    """In order of distance; without a position always last."""
    key = F.asc_nulls_last("km") if ascending else F.desc_nulls_last("km")
    return distances(points, lat, lon).orderBy(key, "id")


def clusters(points: DataFrame, cell: float) -> DataFrame:
    """(gx, gy, n, lat, lon): points per grid cell and their mean position."""
    located = points.where("lat IS NOT NULL AND lon IS NOT NULL")
    grouped = located.groupBy(grid_cell(F.col("lat"), cell).alias("gx"), grid_cell(F.col("lon"), cell).alias("gy"))
    return grouped.agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def used_cities(files: DataFrame, cities: DataFrame) -> DataFrame:
    counted = files.where("city_id IS NOT NULL").groupBy("city_id").agg(F.count("*").alias("n_files"))
    return counted.join(cities.select(F.col("id").alias("city_id"), "name"), "city_id")


def find_cities(cities: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Cities by the start of their name, without case, most people first."""
    return cities.where(F.lower("name").startswith(prefix.lower())).orderBy(F.desc("population"), "id").limit(limit)
