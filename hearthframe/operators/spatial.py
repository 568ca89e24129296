"""Nearest facility and count within a radius, by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthframe import constants as K
from hearthframe.functions import measures as M
from hearthframe.session import materialise, spread

METRES_PER_DEGREE = math.pi * K.EARTH_DIAMETER_M / 360.0
# Cell sizes in degrees of the search around a point; what they do not settle goes down the tree of cells.
NEAR_LEVELS = (0.02, 0.1)
# Cell sizes of the search for towns; the last covers the whole range of both coordinates.
TOWN_LEVELS = (0.02, 0.1, 0.5, 2.5, 400.0)
# The tree halves 512 degrees this often, three halvings a level, and stops at cells of a few points.
TREE_BITS, TREE_STEP, TREE_LEAF = 27, 3, 32


def _cell(df: DataFrame, size: float) -> DataFrame:
    return df.withColumn("cy", F.floor(F.col("latitude") / size)).withColumn("cx", F.floor(F.col("longitude") / size))


def _around(df: DataFrame, size: float) -> DataFrame:
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return _cell(df, size).withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near)) \
        .withColumn("cy", F.col("cy") + F.col("dy")).withColumn("cx", F.col("cx") + F.col("dx")).drop("dy", "dx")


def _bounds(cells: DataFrame) -> DataFrame:
    """(point, cell) rows with `low`, a distance no point of the cell is nearer than, and `high`, that of one of its points."""
    lat, lon = F.col("latitude"), F.col("longitude")
    gap = F.greatest(F.lit(0.0), F.col("south") - lat, lat - F.col("north"))
    side = F.greatest(F.lit(0.0), F.col("west") - lon, lon - F.col("east"))
    far = F.greatest(F.abs(F.col("west") - lon), F.abs(F.col("east") - lon))

    def half_chord(degrees):
        return F.pow(F.sin(F.radians(degrees) / 2), F.lit(2.0))
    # Each term is the smallest that the cell allows; beyond half a turn a larger gap is nearer again.
    flat = F.least(F.cos(F.radians("south")), F.cos(F.radians("north")))
    chord = half_chord(gap) + F.greatest(F.lit(0.0), F.cos(F.radians(lat)) * flat) * F.least(half_chord(side), half_chord(far))
    low = K.EARTH_DIAMETER_M * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))
    return cells.withColumn("low", low * (1 - 1e-9) - 1e-3).withColumn("high", M.haversine_m(lat, lon, F.col("one.latitude"), F.col("one.longitude")))


def tree_nearest(wanted: DataFrame, targets: DataFrame) -> DataFrame:
    """(category, latitude, longitude, nearest) by descending a tree of cells, level by level.

    A cell knows its box, its number of points and one of them. A point keeps the cells that may hold something nearer
    than the best point known to it; the others, however many facilities they hold, are never opened.
    """
    def index(column: str):
        return F.floor((F.col(column) + 256.0) / 512.0 * (1 << TREE_BITS)).cast("long")
    placed = targets.select("category", "latitude", "longitude", index("latitude").alias("iy"), index("longitude").alias("ix"))

    def at(level: int, column: str):
        return F.shiftright(F.col(column), TREE_BITS - level * TREE_STEP)
    levels = TREE_BITS // TREE_STEP

    def cells(level: int) -> DataFrame:
        return placed.withColumn("cy", at(level, "iy")).withColumn("cx", at(level, "ix")).groupBy("category", "cy", "cx").agg(
            F.count(F.lit(1)).alias("points"), F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"),
            F.max("longitude").alias("east"), F.min(F.struct("latitude", "longitude")).alias("one"))
    key = ["category", "latitude", "longitude"]
    box = ["points", "south", "north", "west", "east", "one"]
    frontier, leaves = wanted.select(*key).withColumn("best", F.lit(float("inf"))).withColumn("cy", F.lit(0).cast("long")).withColumn("cx", F.lit(0).cast("long")), None
    for level in range(levels + 1):
        side = cells(level).withColumn("py", F.shiftright("cy", TREE_STEP) if level else F.col("cy")).withColumn("px", F.shiftright("cx", TREE_STEP) if level else F.col("cx"))
        opened = _bounds(frontier.select(*key, "best", F.col("cy").alias("py"), F.col("cx").alias("px")).join(side, ["category", "py", "px"]))
        # A point's cells are few; the best of them bounds all.
        bound = opened.groupBy(*key).agg(F.least(F.min("best"), F.min("high")).alias("bound"))
        kept = opened.join(bound, key).filter(F.col("low") <= F.col("bound")).select(*key, F.col("bound").alias("best"), "cy", "cx", *box)
        kept = materialise(kept, f"tree-{level}")
        ends = F.lit(True) if level == levels else F.col("points") <= TREE_LEAF
        part = kept.filter(ends).select(*key, "best", F.lit(level).alias("level"), "cy", "cx")
        leaves = part if leaves is None else leaves.unionByName(part)
        frontier = kept.filter(~ends)
        if level < levels and frontier.isEmpty():
            break
    every = placed.select("category", F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("level"), at(n, "iy").alias("cy"), at(n, "ix").alias("cx")) for n in range(level + 1)])).alias("c")) \
        .select("category", "t_lat", "t_lon", "c.*")
    d = M.haversine_m(F.col("latitude"), F.col("longitude"), F.col("t_lat"), F.col("t_lon"))
    found = leaves.join(every, ["category", "level", "cy", "cx"]).groupBy(*key).agg(F.min(d).alias("nearest"))
    return found


def _within(wanted: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(category, latitude, longitude): facilities within ``radius``, by cells at least a radius wide on both axes."""
    tall = radius / METRES_PER_DEGREE * 1.001
    top = (wanted.agg(F.max(F.abs(F.col("latitude")))).first()[0] or 0.0) + tall
    wide = tall / math.cos(math.radians(top)) if top < 89 else 360.0

    def cell(df: DataFrame) -> DataFrame:
        return df.withColumn("cy", F.floor(F.col("latitude") / tall)).withColumn("cx", F.floor(F.col("longitude") / wide))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = cell(wanted).withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near)) \
        .withColumn("cy", F.col("cy") + F.col("dy")).withColumn("cx", F.col("cx") + F.col("dx"))
    side = cell(targets).select("category", "cy", "cx", F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"), "n")
    d = M.haversine_m(F.col("latitude"), F.col("longitude"), F.col("t_lat"), F.col("t_lon"))
    return asked.join(side, ["category", "cy", "cx"]).where(d <= radius).groupBy("category", "latitude", "longitude").agg(F.sum("n").alias("within"))


def nearest_and_within(blocks: DataFrame, facilities: DataFrame, radius: float = K.WITHIN_RADIUS_M) -> DataFrame:
    """(block_id, category): smallest distance (0.1 m) and number of facilities within ``radius``.

    A block without coordinates keeps its rows, with no distance and a count of zero.

    Points are first reduced to distinct coordinates with counts, so a third of
    all facilities at one address is one row. Each level meets only the 3x3 cells
    around a point; a point is settled once its nearest find lies within the
    distance the level is sure to cover, and only unsettled ones go to the next,
    coarser level, and in the end down a tree of cells that bounds prune.
    """
    points = blocks.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("latitude", "longitude").distinct()
    targets = facilities.filter("latitude IS NOT NULL AND longitude IS NOT NULL").groupBy("category", "latitude", "longitude") \
        .agg(F.count(F.lit(1)).alias("n"))
    targets = materialise(targets, "facility-points")
    # Facility categories are a short fixed vocabulary; each point asks about all of them.
    vocabulary = targets.agg(F.collect_set("category").alias("c")).scalar()
    wanted = points.withColumn("category", F.explode(vocabulary))
    key = ["category", "latitude", "longitude"]
    open_, settled = wanted, None
    for i, size in enumerate(NEAR_LEVELS):
        side = _cell(targets.select("category", F.col("latitude"), F.col("longitude"), "n"), size) \
            .select("category", "cy", "cx", F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"), "n")
        pairs = _around(open_, size).join(side, ["category", "cy", "cx"]).withColumn(
            "d", M.haversine_m(F.col("latitude"), F.col("longitude"), F.col("t_lat"), F.col("t_lon")))
        found = pairs.groupBy(*key).agg(F.min("d").alias("nearest"))
        sure = F.lit(size * METRES_PER_DEGREE) * F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("latitude")) + size)))
        state = materialise(open_.join(found, key, "left"), f"nearest-{i}")
        done = F.coalesce(F.col("nearest") <= sure, F.lit(False))
        part = state.filter(done).select(*key, "nearest")
        settled = part if settled is None else settled.unionByName(part)
        open_ = state.filter(~done).select(*key)
    if not open_.isEmpty():
        settled = settled.unionByName(tree_nearest(open_, targets))
    result = settled.join(_within(wanted, targets, radius), key, "left")
    out = blocks.select("block_id", "latitude", "longitude", F.explode(vocabulary).alias("category")).join(result, key, "left")
    return out.select("block_id", "category", F.round("nearest", 1).alias("nearest_m"), F.coalesce("within", F.lit(0)).alias("within_radius"))


def pivot_categories(found: DataFrame, categories: list[str]) -> DataFrame:
    """Wide block features: two columns per category."""
    return found.groupBy("block_id").agg(*[
        c for name in categories for c in (
            F.max(F.when(F.col("category") == name, F.col("nearest_m"))).alias(f"nearest_{name.lower()}_m"),
            F.max(F.when(F.col("category") == name, F.col("within_radius"))).alias(f"{name.lower()}_within_1km"))])


def nearest_town(requests: DataFrame, sales: DataFrame) -> DataFrame:
    """Per request, the town selling its flat type whose nearest sale is closest in squared degrees,
    then the one with most sales, then the first by name.

    Requests meet places through the same widening grid as facilities; a request
    without coordinates gets the town with most sales of its type.
    """
    kind = ["flat_type"]
    totals = sales.groupBy(*kind, "town").agg(F.count(F.lit(1)).alias("sales"))
    spots = sales.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select(*kind, "town", "latitude", "longitude").distinct()
    places = materialise(spots.join(totals, [*kind, "town"]), "town-places")
    open_ = requests.select("request_id", *kind, "latitude", "longitude")
    blind = open_.filter("latitude IS NULL OR longitude IS NULL").join(totals, kind).groupBy("request_id").agg(
        F.min_by(F.struct("town", "sales"), F.struct((-F.col("sales")).alias("a"), F.col("town").alias("b"))).alias("x"))
    open_ = open_.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    settled = blind.select("request_id", "x")
    for i, size in enumerate(TOWN_LEVELS):
        side = _cell(places, size).select(*kind, "cy", "cx", F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"), "town", "sales")
        dlat, dlon = F.col("t_lat") - F.col("latitude"), F.col("t_lon") - F.col("longitude")
        def met(rows: DataFrame) -> DataFrame:
            return _around(rows, size).join(side, [*kind, "cy", "cx"]).withColumn("d2", dlat * dlat + dlon * dlon)
        # The smallest distance is a number that tasks combine by hashing; only places at that distance are sorted by sales and name.
        nearest = met(spread(open_)).groupBy("request_id").agg(F.min("d2").alias("least"))
        state = materialise(open_.join(nearest, "request_id", "left"), f"town-{i}")
        last = i == len(TOWN_LEVELS) - 1
        done = F.col("least").isNotNull() if last else F.coalesce(F.col("least") <= size * size, F.lit(False))
        won = met(spread(state.filter(done))).filter(F.col("d2") == F.col("least")).groupBy("request_id").agg(
            F.min_by(F.struct("town", "sales"), F.struct((-F.col("sales")).alias("a"), F.col("town").alias("b"))).alias("x"))
        settled = settled.unionByName(state.filter(done).select("request_id").join(won, "request_id"))
        open_ = state.filter(~done).select("request_id", *kind, "latitude", "longitude")
    return settled.select("request_id", F.col("x.town").alias("town"), F.col("x.sales").alias("sales"))
