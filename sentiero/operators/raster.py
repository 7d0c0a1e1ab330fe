"""Rasters as pixel tables (row, col, v): mosaics, sampling, slope and shade, statistics by zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage
from .ranking import exact_quantiles


def mosaic(tiles: DataFrame) -> DataFrame:
    """(row, col, v) of overlapping tiles (rank, row, col, v): the first tile with a value wins."""
    return tiles.where("v is not null").groupBy("row", "col").agg(F.min_by("v", "rank").alias("v"))


def sample_points(points: DataFrame, pixels: DataFrame, x0: float, y0: float, size: float, nodata: float = -9999.0) -> DataFrame:
    """``points`` (.., x, y) with ``v`` of their pixel; null outside, for nodata and infinities. Row 0 is at y0, downwards."""
    at = points.withColumn("row", F.floor((F.lit(y0) - F.col("y")) / size).cast("int")).withColumn("col", F.floor((F.col("x") - F.lit(x0)) / size).cast("int"))
    good = pixels.where((F.col("v") != nodata) & ~F.isnan("v") & (F.abs("v") < float("inf"))).select("row", "col", "v")
    return at.join(good, ["row", "col"], "left").drop("row", "col")


def gradient(pixels: DataFrame, size: float, block: int = 2048) -> DataFrame:
    """(row, col, v, dz_dx, dz_dy): central differences, one-sided at borders; null where no neighbour is known.

    Neighbours are fetched by an equi-join on the pixel's place, which needs no window over whole rows or columns.
    """
    near = pixels.select(F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col"), F.lit(name).alias("side"), F.col("v").alias("w")) for i, j, name in ((0, -1, "e"), (0, 1, "w"), (-1, 0, "s"), (1, 0, "n"))])).alias("n")).select("n.*")
    sides = near.groupBy("row", "col").agg(*[F.max(F.when(F.col("side") == s, F.col("w"))).alias(s) for s in "ewsn"])
    at = pixels.join(sides, ["row", "col"], "left")
    slope = lambda hi, lo: F.when(F.col(hi).isNotNull() & F.col(lo).isNotNull(), (F.col(hi) - F.col(lo)) / (2 * size)).when(F.col(hi).isNotNull(), (F.col(hi) - F.col("v")) / size).when(F.col(lo).isNotNull(), (F.col("v") - F.col(lo)) / size)
    return at.select("row", "col", "v", slope("e", "w").alias("dz_dx"), slope("s", "n").alias("dz_dy"))


def slope_degrees(dz_dx: Column, dz_dy: Column) -> Column:
    return F.degrees(F.atan(F.hypot(dz_dx, dz_dy)))


def slope_percent(dz_dx: Column, dz_dy: Column) -> Column:
    return 100 * F.hypot(dz_dx, dz_dy)


def aspect_degrees(dz_dx: Column, dz_dy: Column) -> Column:
    """Compass direction of the slope, 0-360."""
    return F.pmod(F.lit(90.0) - F.degrees(F.atan2(dz_dy, -dz_dx)), F.lit(360.0))


def hillshade(dz_dx: Column, dz_dy: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """Brightness 0-255 under a light from ``azimuth`` at ``altitude``."""
    s, light, up = F.atan(F.hypot(dz_dx, dz_dy)), F.radians(F.lit(360.0 - azimuth + 90)), F.radians(F.lit(altitude))
    facing = F.atan2(dz_dy, -dz_dx)
    shade = 255 * (F.sin(up) * F.cos(s) + F.cos(up) * F.sin(s) * F.cos(light - facing))
    return F.when(shade.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(255.0), shade)))


def fill_gaps(pixels: DataFrame, places: DataFrame, reach: int = 100) -> DataFrame:
    """(row, col, v) of all ``places``: missing values as the mean of known ones near them, by inverse squared distance.

    Rings widen (3, 9, 27 .. up to ``reach`` pixels) and only holes without a known pixel so far go on to the next, so
    each hole is filled from the first ring that has one. Places with nothing known within ``reach`` keep null.
    """
    known = pixels.where("v is not null").select("row", "col", "v")
    done = places.select("row", "col").join(known, ["row", "col"]).select("row", "col", "v")
    holes = stage(places.select("row", "col").join(known, ["row", "col"], "left_anti"))
    ring = 0
    while ring < reach and holes.limit(1).count():
        ring = min(reach, max(3, ring * 3))
        cell = F.lit(ring)
        # Known pixels go to the cells of the ring's width around them, holes to their own: one equi-join at every width.
        near = known.select(F.col("row").alias("pr"), F.col("col").alias("pc"), "v", F.explode(F.array(*[F.struct((F.floor(F.col("row") / cell) + i).alias("cr"), (F.floor(F.col("col") / cell) + j).alias("cc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("k")).select("pr", "pc", "v", "k.*")
        at = holes.withColumn("cr", F.floor(F.col("row") / cell)).withColumn("cc", F.floor(F.col("col") / cell))
        weight = 1.0 / (F.pow(F.col("row") - F.col("pr"), 2) + F.pow(F.col("col") - F.col("pc"), 2))
        pairs = at.join(near, ["cr", "cc"]).where((F.abs(F.col("row") - F.col("pr")) <= ring) & (F.abs(F.col("col") - F.col("pc")) <= ring)).withColumn("w", weight)
        filled = stage(pairs.groupBy("row", "col").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v")))
        done, holes = done.unionByName(filled), stage(holes.join(filled, ["row", "col"], "left_anti"))
    return done.unionByName(holes.withColumn("v", F.lit(None).cast("double")))


def overview(pixels: DataFrame, factor: int) -> DataFrame:
    """Means of blocks of ``factor`` pixels each way."""
    return pixels.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg("v").alias("v"))


def zonal_stats(pixels: DataFrame, zones: DataFrame, zone: str = "zone") -> DataFrame:
    """Statistics of ``v`` of pixels (zone, v) for every row of ``zones``; zones without pixels have n 0 and nulls."""
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    each = pixels.where("v is not null").groupBy(zone).agg(F.count("v").alias("n"), F.min("v").alias("minimo"), q.alias("q"), F.avg("v").alias("media"), F.max("v").alias("massimo"), F.stddev_pop("v").alias("dev"))
    out = zones.select(zone).join(each, zone, "left")
    return out.select(zone, F.coalesce("n", F.lit(0)).alias("n"), "minimo", F.col("q")[0].alias("p25"), "media", F.col("q")[1].alias("mediana"), F.col("q")[2].alias("p75"), "massimo", "dev")


def raster_stats(pixels: DataFrame) -> DataFrame:
    """One row: n, min, mean, median, p90, max; the quantiles by range buckets."""
    one = pixels.agg(F.count("v").alias("n"), F.min("v").alias("minimo"), F.avg("v").alias("media"), F.max("v").alias("massimo"))
    q = exact_quantiles(pixels, ["v"], (0.5, 0.9))
    return one.crossJoin(F.broadcast(q)).select("n", "minimo", "media", F.col("v")[0].alias("mediana"), F.col("v")[1].alias("p90"), "massimo")
