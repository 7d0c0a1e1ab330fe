"""Points near other points, and points in regions, over k-d splits of the sphere with halo copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kdtree import Splits, chord, haversine_m, pairs_within, unit_vectors
from ..runtime import stage, width

#: Rows of the sample that only places the split planes, a few for each leaf; every row takes part in the search.
SAMPLE_ROWS, SAMPLE_OF_LEAF, SAMPLE_MOST = 20_000, 8, 2_000_000
#: Points of both sides that one leaf of the split holds about.
LEAF_POINTS = 20_000


def _splits(points: DataFrame, rows: int, leaf_points: int) -> Splits:
    """Planes from a bounded sample of (lat, lon); they balance the work and don't touch the result."""
    wanted = min(SAMPLE_MOST, max(SAMPLE_ROWS, SAMPLE_OF_LEAF * rows // leaf_points))
    share = min(1.0, wanted / max(rows, 1))
    sample = points.sample(share, seed=7).limit(2 * wanted) if share < 1 else points
    at = sample.toPandas()
    vectors = unit_vectors(at["lat"].to_numpy(float), at["lon"].to_numpy(float)) if len(at) else np.zeros((0, 3))
    leaves = max(points.sparkSession.sparkContext.defaultParallelism, rows / leaf_points)
    return Splits(vectors, max(1, int(len(at) / leaves)))


def _to_leaves(df: DataFrame, splits: Splits, radius: float) -> DataFrame:
    """Rows of ``df`` (id, lat, lon) with the leaves they belong to; with a radius also the leaves that need a halo copy."""
    shared = df.sparkSession.sparkContext.broadcast(splits)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row, leaf = shared.value.reach(unit_vectors(batch["lat"], batch["lon"]), radius)
            out = batch.iloc[row].copy()
            out["leaf"] = leaf
            yield out

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInPandas(place, f"id {kind['id']}, lat double, lon double, leaf int")


def within_distance(left: DataFrame, right: DataFrame, metres: float, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Pairs (left_id, right_id, metri) of rows of ``left`` and ``right`` (id, lat, lon) at most ``metres`` apart.

    Positions become unit vectors; k-d planes cut space into leaves of about ``leaf_points`` points, each left row goes to
    its leaf and each right row to every leaf within the chord of ``metres``; a local k-d tree answers each leaf. So a
    crowded locality is cut by further planes and no task gets more than its leaf. Only points with identical
    coordinates can't be cut apart: those are grouped first and expanded at the end.
    Null ids or positions give no pair; repeated rows give one; empty tables give none.
    """
    spots_l, spots_r = (d.where(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", F.col("lat").cast("double"), F.col("lon").cast("double")).distinct() for d in (left, right))
    spots_l, spots_r = stage(spots_l), stage(spots_r)  # read four times below
    kind_l, kind_r = (d.schema["id"].dataType.simpleString() for d in (left, right))
    places_l = spots_l.select(F.struct("lat", "lon").alias("id"), "lat", "lon").distinct()
    places_r = spots_r.select(F.struct("lat", "lon").alias("id"), "lat", "lon").distinct()
    key = lambda: F.concat_ws("/", F.col("lat").cast("string"), F.col("lon").cast("string"))
    places_l, places_r = (p.select(key().alias("id"), "lat", "lon") for p in (places_l, places_r))
    rows = spots_l.count() + spots_r.count()
    splits = _splits(spots_l.select("lat", "lon").unionByName(spots_r.select("lat", "lon")), rows, leaf_points)
    radius = chord(metres)

    def answer(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [(q, p) for q, p in pairs_within(unit_vectors(a["lat"], a["lon"]), unit_vectors(b["lat"], b["lon"]), radius)]
        if not found:
            return pd.DataFrame({"la": pd.Series(dtype=float), "lo": pd.Series(dtype=float), "ra": pd.Series(dtype=float), "ro": pd.Series(dtype=float), "metri": pd.Series(dtype=float)})
        q, p = (np.concatenate(x) for x in zip(*found, strict=True))
        la, lo, ra, ro = a["lat"].to_numpy()[q], a["lon"].to_numpy()[q], b["lat"].to_numpy()[p], b["lon"].to_numpy()[p]
        d = haversine_m(la, lo, ra, ro)
        keep = d <= metres
        return pd.DataFrame({"la": la[keep], "lo": lo[keep], "ra": ra[keep], "ro": ro[keep], "metri": d[keep]})

    tasks = width(left.sparkSession, splits.leaves, 1)
    a = _to_leaves(places_l, splits, 0.0).repartition(tasks, "leaf")
    b = _to_leaves(places_r, splits, radius).repartition(tasks, "leaf")
    near = a.groupBy("leaf").cogroup(b.groupBy("leaf")).applyInPandas(answer, "la double, lo double, ra double, ro double, metri double")
    out = near.join(spots_l.select(F.col("id").alias("left_id"), F.col("lat").alias("la"), F.col("lon").alias("lo")), ["la", "lo"]).join(spots_r.select(F.col("id").alias("right_id"), F.col("lat").alias("ra"), F.col("lon").alias("ro")), ["ra", "ro"])
    return out.select(F.col("left_id").cast(kind_l), F.col("right_id").cast(kind_r), "metri")


def _sweep(points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """(id, region) of the points inside regions: a sweep over x keeps the edges that span the current x."""
    px, py, ids = points["x"].to_numpy(float), points["y"].to_numpy(float), points["id"].to_numpy()
    low = np.minimum(edges["x1"], edges["x2"]).to_numpy(float)
    high = np.maximum(edges["x1"], edges["x2"]).to_numpy(float)
    x1, y1, x2, y2 = (edges[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))
    region = edges["region"].to_numpy()
    use = np.nonzero(high > low)[0]
    use = use[np.argsort(low[use], kind="stable")]
    active, nxt, out_id, out_region = np.empty(0, int), 0, [], []
    for k in np.argsort(px, kind="stable"):
        x = px[k]
        began = nxt
        while nxt < len(use) and low[use[nxt]] <= x:
            nxt += 1
        if nxt > began:
            active = np.concatenate((active, use[began:nxt]))
        active = active[high[active] > x]  # half-open in x: a vertex belongs to the edge on its right
        if not len(active):
            continue
        y = y1[active] + (x - x1[active]) * (y2[active] - y1[active]) / (x2[active] - x1[active])
        over = region[active[y > py[k]]]
        if len(over):
            names, n = np.unique(over, return_counts=True)
            inside = names[n % 2 == 1]
            out_id.extend([ids[k]] * len(inside))
            out_region.extend(inside)
    return pd.DataFrame({"id": out_id, "region": out_region})


def in_regions(points: DataFrame, rings: DataFrame, cell: float, block: int = 100_000) -> DataFrame:
    """Pairs (id, region) of points (id bigint, x, y) and the regions (region bigint, ring array<struct<x,y>>) around them.

    Edges go to every vertical strip of width ``cell`` they touch and points to their strip; a strip with more than
    ``block`` points is dealt out to several tasks, each with a copy of the strip's edges. A plane sweep over x in each
    task counts the edges above every point.
    Points exactly on an upper or right border are outside, on a lower or left border inside. Null points, rings of
    under three corners and empty tables give no pair; a region may have several rings (holes count by parity).
    """
    ring = rings.where(F.col("region").isNotNull() & (F.size("ring") >= 3))
    corners = ring.select("region", F.posexplode("ring").alias("i", "p"), F.col("ring"))
    nxt = F.get(F.col("ring"), (F.col("i") + 1) % F.size("ring"))
    edges = corners.select("region", F.col("p.x").cast("double").alias("x1"), F.col("p.y").cast("double").alias("y1"), nxt["x"].cast("double").alias("x2"), nxt["y"].cast("double").alias("y2"))
    strip = lambda x: F.floor(x / F.lit(cell))
    edges = edges.withColumn("strip", F.explode(F.sequence(strip(F.least("x1", "x2")), strip(F.greatest("x1", "x2")))))
    spots = points.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col("id").cast("bigint"), F.col("x").cast("double"), F.col("y").cast("double"))
    spots = spots.withColumn("strip", strip(F.col("x")))
    blocks = spots.groupBy("strip").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    spots = spots.join(blocks, "strip").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    copies = blocks.select("strip", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    edges = edges.join(copies, "strip").select(*[F.col(c).alias(c) for c in ("strip", "part", "region", "x1", "y1", "x2", "y2")])
    spots = spots.select(*[F.col(c).alias(c) for c in ("strip", "part", "id", "x", "y")])
    return spots.groupBy("strip", "part").cogroup(edges.groupBy("strip", "part")).applyInPandas(lambda a, b: _sweep(a, b), "id bigint, region bigint")
