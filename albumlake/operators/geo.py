"""Places: nearest city, grid of a map, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import effective_latitude, effective_longitude, effective_place, haversine_km
from ..sources.scratch import Scratch


def _xyz(lat: Column, lon: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _dot(e: Column) -> Column:
    return F.col("x") * e["cx"] + F.col("y") * e["cy"] + F.col("z") * e["cz"]


LEVELS = 14  # a cube of the finest level has a side of some 800 m


def _cube(q: str, level: int) -> Column:
    """Number of the cube of a level that holds the finest cube (``q``x, ``q``y, ``q``z)."""
    at = [F.shiftright(F.col(f"{q}{a}"), LEVELS - level) for a in "xyz"]
    return F.shiftleft(at[0], 2 * level) + F.shiftleft(at[1], level) + at[2]


def _apart(p: str, c: str, level: int) -> Column:
    """Distance of the middles of two cubes of a level, in units of their side."""
    part = lambda k, a: F.shiftright(F.col(k), level * (2 - a)).bitwiseAND(F.lit((1 << level) - 1))
    return F.sqrt(sum(((part(p, a) - part(c, a)).cast("double") ** 2 for a in range(3)), F.lit(0.0)))


def _in_cubes(df: DataFrame) -> DataFrame:
    """With the finest cube (qx, qy, qz) of the unit vector (x, y, z)."""
    n = 1 << LEVELS
    cube = lambda a: F.least(F.floor((F.col(a) + 1) / 2 * n), F.lit(n - 1)).cast("long")
    return df.withColumns({f"q{a}": cube(a) for a in "xyz"})


def city_candidates(points: DataFrame, cities: DataFrame, work: Scratch, few: int = 32, finest: int = LEVELS) -> list[tuple[int, DataFrame]]:
    """For some levels (level, table of cube p and cube c): the cubes of cities that can hold the
    nearest city to a point in cube p. Every point's cube is in the table of one level.

    Points and cities lie in an octree around the globe. From level to level, each occupied cube of
    points keeps the cubes of cities that aren't farther from it than the nearest one by more than two
    diagonals of a cube; its children meet the children of those. A cube whose candidates hold at most
    ``few`` cities is done. The kept cubes of a cube lie in a patch of a bounded number of cubes.
    """
    near = points.select("qx", "qy", "qz").distinct()
    near, far = work.keep(near), work.keep(cities.groupBy("qx", "qy", "qz").agg(F.count("*").alias("n")))
    done, active = [], None
    for level in range(finest + 1):
        p = near.select(_cube("q", level).alias("p"), _cube("q", max(0, level - 1)).alias("up")).distinct()
        c = far.groupBy(_cube("q", level).alias("c"), _cube("q", max(0, level - 1)).alias("above")).agg(F.sum("n").alias("n"))
        if active is None:
            met = p.join(c, F.lit(True))  # one cube each
        else:
            met = active.select(F.col("p").alias("up"), F.col("c").alias("above")).join(p, "up").join(c, "above")
        own = Window.partitionBy("p")
        met = met.select("p", "c", "n", _apart("p", "c", level).alias("d")).withColumn("least", F.min("d").over(own))
        kept = met.filter(F.col("d") <= F.col("least") + 2 * math.sqrt(3) + 1e-6).withColumn("total", F.sum("n").over(own))
        kept = work.keep(kept.select("p", "c", (F.col("total") <= few).alias("few")))
        last = level == finest
        done.append((level, kept if last else kept.filter("few")))
        active = kept.filter("not few")
        if last or active.isEmpty():
            return done
    return done


def nearest_city(points: DataFrame, cities: DataFrame, few: int = 32, cell: float = 0.007) -> DataFrame:
    """Points with coordinates and without a place text, with their nearest city and its distance.

    Any number of both: ``city_candidates`` leaves each cube of points a bounded number of cubes of
    cities, and a point compares the cities of those. Best is the highest product of unit vectors;
    equal ones go to the smaller city id. Cubes of less than ``cell`` degrees aren't split.
    """
    work = Scratch(points.sparkSession)
    finest = min(LEVELS, max(0, int(math.log2(2 / math.radians(cell)))))
    c = cities.select(F.col("id").alias("city_id"), F.col("name").alias("city"), F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"))
    c = work.keep(_in_cubes(c.withColumns(dict(zip("xyz", _xyz(F.col("c_lat"), F.col("c_lon")))))))
    todo = points.filter(effective_latitude().isNotNull() & effective_longitude().isNotNull() & (F.coalesce("geo_text", F.lit("")) == ""))
    todo = todo.select("id", effective_latitude().alias("lat"), effective_longitude().alias("lon"))
    todo = work.keep(_in_cubes(todo.withColumns(dict(zip("xyz", _xyz(F.col("lat"), F.col("lon")))))))
    each = F.struct("city_id", "city", "c_lat", "c_lon", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    found = None
    for level, pairs in city_candidates(todo, c, work, few, finest):
        lists = pairs.join(c.withColumn("c", _cube("q", level)), "c").groupBy("p").agg(F.collect_list(each).alias("near"))
        one = todo.withColumn("p", _cube("q", level)).join(lists, "p").drop("p")
        found = one if found is None else found.unionByName(one)
    best = F.array_max(F.transform("near", lambda e: F.struct(F.round(_dot(e), 12).alias("s"), (-e["city_id"]).alias("k"), e["city"].alias("city"), e["c_lat"].alias("c_lat"), e["c_lon"].alias("c_lon"))))
    found = found.withColumn("b", best)
    return found.select("id", (-F.col("b.k")).alias("city_id"), F.col("b.city").alias("city"), F.round(haversine_km("lat", "lon", "b.c_lat", "b.c_lon"), 3).alias("km"))


def geo_grid(assets: DataFrame, step: float, west: float = -180, south: float = -90, east: float = 180, north: float = 90, most: int = 4096) -> DataFrame:
    """Cells of a map: count, mean position, how many places are by hand or from metadata, smallest
    id and bounds. The first ``most`` cells in order, as a map shows."""
    step = min(10.0, max(1e-4, step))
    lat, lon = effective_latitude(), effective_longitude()
    at = assets.select("id", lat.alias("lat"), lon.alias("lon"), (F.col("user_latitude").isNotNull()).alias("manual")).filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    cells = at.groupBy(F.floor((F.col("lat") + 90) / step).alias("cell_y"), F.floor((F.col("lon") + 180) / step).alias("cell_x")).agg(
        F.count("*").alias("n"),
        F.avg("lat").alias("latitude"),
        F.avg("lon").alias("longitude"),
        F.count_if("manual").alias("manual"),
        F.count_if(~F.col("manual")).alias("metadata"),
        F.min("id").alias("first_id"),
    )
    south_edge, west_edge = F.col("cell_y") * step - 90, F.col("cell_x") * step - 180
    bounded = cells.withColumns({"south": south_edge, "west": west_edge, "north": F.least(F.lit(90.0), south_edge + step), "east": F.least(F.lit(180.0), west_edge + step)})
    return bounded.orderBy("cell_y", "cell_x").limit(most)


def place_labels(assets: DataFrame, most: int = 500) -> DataFrame:
    """Labels by falling count, the user's before metadata's."""
    named = assets.select(effective_place().alias("place")).filter("place <> ''")
    return named.groupBy("place").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "place").limit(most)


def places_of(assets: DataFrame, frozen: DataFrame) -> DataFrame:
    """Assets of a frozen result only."""
    return assets.join(frozen.select(F.col("asset_id").alias("id")), "id", "left_semi")
