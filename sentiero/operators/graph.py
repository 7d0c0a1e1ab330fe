"""Walking networks: densified lines, directed edges, components, shortest paths, reach and catchments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import tobler_kmh
from ..functions.geometry import line_length
from .ranking import exact_quantiles
from ..runtime import stage
from .components import connected_components


def densify(lines: DataFrame, step: float = 25.0) -> DataFrame:
    """(line_id, seq, x, y, d): max(2, floor(length / step) + 1) points spaced equally along each line (line_id, line).

    Each leg makes the points that lie on it; one where two legs meet belongs to the first, and the last leg makes the rest.
    Every row is a line of its own, also where ids repeat.
    """
    at = lines.withColumn("row", F.monotonically_increasing_id()).withColumn("len", line_length(F.col("line"))).withColumn("n", F.greatest(F.lit(2), F.floor(F.col("len") / step).cast("int") + 1))
    legs = at.select("row", "line_id", "len", "n", (F.size("line") - 2).alias("last"), F.posexplode(F.arrays_zip(F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b"))).alias("leg", "s"))
    legs = legs.withColumn("dx", F.col("s.b.x") - F.col("s.a.x")).withColumn("dy", F.col("s.b.y") - F.col("s.a.y")).withColumn("l", F.hypot("dx", "dy"))
    upto = F.sum("l").over(Window.partitionBy("row").orderBy("leg").rowsBetween(Window.unboundedPreceding, 0))
    legs = legs.withColumn("end", upto)
    # Points up to the end of each leg; a line without length has all on its first.
    reached = F.least(F.col("n"), F.coalesce(F.floor(F.try_divide((F.col("end") + 1e-9) * (F.col("n") - 1), F.col("len"))).cast("int") + 1, F.col("n")))
    legs = legs.withColumn("start", F.col("end") - F.col("l")).withColumn("upto", F.when(F.col("leg") == F.col("last"), F.col("n")).otherwise(reached))
    legs = legs.withColumn("first", F.lag("upto", 1, 0).over(Window.partitionBy("row").orderBy("leg"))).where(F.col("first") < F.col("upto"))
    on = legs.select("line_id", F.explode(F.sequence(F.col("first"), F.col("upto") - 1)).alias("seq"), "n", "len", "s", "dx", "dy", "l", "start").withColumn("d", F.col("len") * F.col("seq") / (F.col("n") - 1))
    t = F.when(F.col("l") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("d") - F.col("start")) / F.col("l")))).otherwise(0.0)
    return on.select("line_id", "seq", (F.col("s.a.x") + t * F.col("dx")).alias("x"), (F.col("s.a.y") + t * F.col("dy")).alias("y"), "d")


def walking_edges(segments: DataFrame, flat_kmh: float = 4.5, stairs_kmh: float = 1.8, least_m: float = 0.5) -> DataFrame:
    """Directed edges (src, dst, t, t_flat, d) in minutes of segments (x1, y1, z1, x2, y2, z2, stairs), both ways.

    Speed follows the slope of the direction walked, on stairs at most ``stairs_kmh``; ends are rounded to 0.1 m, pieces
    under ``least_m`` left out; of parallel edges the fastest stays. Missing heights count as no rise.
    """
    node = lambda x, y: F.format_string("%.1f_%.1f", F.bround(x, 1), F.bround(y, 1))
    d = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    rise = F.coalesce(F.col("z2") - F.col("z1"), F.lit(0.0))
    base = segments.withColumn("d", d).where(F.col("d") >= least_m).withColumn("slope", rise / F.col("d")).withColumn("u", node(F.col("x1"), F.col("y1"))).withColumn("v", node(F.col("x2"), F.col("y2")))

    def minutes(slope: Column) -> Column:
        speed = tobler_kmh(slope)
        speed = F.when(F.col("stairs"), F.least(speed, F.lit(stairs_kmh))).otherwise(speed)
        return F.col("d") / (speed * 1000 / 60)

    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), minutes(F.col("slope")).alias("t")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), minutes(-F.col("slope")).alias("t")))
    each = base.select(F.explode(both).alias("e"), "d").select("e.*", (F.col("d") / (flat_kmh * 1000 / 60)).alias("t_flat"), "d").where("src <> dst")
    return each.groupBy("src", "dst").agg(F.min(F.struct("t", "t_flat", "d")).alias("m")).select("src", "dst", "m.*")


def reverse(edges: DataFrame) -> DataFrame:
    """Edges with their direction turned."""
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def repaired_weights(edges: DataFrame, missing: str = "estimate") -> DataFrame:
    """``walk_time_s`` filled from travel_time, length / 1.2 or 1 ("estimate"), or infinity ("block")."""
    if missing == "block":
        return edges.withColumn("walk_time_s", F.coalesce("walk_time_s", F.lit(float("inf"))))
    return edges.withColumn("walk_time_s", F.coalesce("walk_time_s", "travel_time", F.col("length") / 1.2, F.lit(1.0)))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges within the weakly connected component of most vertices (the smallest name on ties)."""
    parts = stage(connected_components(edges))
    best = parts.groupBy("component").agg(F.count("*").alias("n")).agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("component"))
    inside = parts.join(F.broadcast(best), "component", "left_semi").select(F.col("id").alias("src"))
    return edges.join(inside, "src", "left_semi")


def shortest_paths(edges: DataFrame, seeds: DataFrame, weight: str = "t", cutoff: float | None = None) -> DataFrame:
    """(source, id, cost, via): least cost from each source to each vertex it reaches, within ``cutoff``.

    ``seeds`` (source, id, cost): where each source enters, at which cost, carried name ``via`` being the seed's id; one
    source with many seeds is a multi-source search, and turned edges give costs towards the seeds. Relaxation by
    rounds over the frontier that improved; ties go to the smaller ``via``. Each round's state is written to the shared
    folder. Weights must not be negative; null or infinite ones block an edge.
    """
    e = stage(edges.where(F.col(weight).isNotNull() & (F.col(weight) < float("inf"))).groupBy("src", "dst").agg(F.min(weight).alias("w")))
    best = stage(seeds.groupBy("source", "id").agg(F.min(F.struct("cost", F.col("id").alias("via"))).alias("b")).select("source", "id", "b.cost", "b.via"))
    front = best
    while True:
        step = front.join(e, front["id"] == e["src"]).select("source", F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), "via")
        if cutoff is not None:
            step = step.where(F.col("cost") <= cutoff)
        step = step.groupBy("source", "id").agg(F.min(F.struct("cost", "via")).alias("n"))
        merged = best.join(step, ["source", "id"], "full").select("source", "id", F.struct("cost", "via").alias("o"), "n", F.col("cost").isNull().alias("fresh"))
        better = F.col("n").isNotNull() & (F.col("fresh") | (F.col("n") < F.col("o")))
        state = stage(merged.select("source", "id", F.when(better, F.col("n")).otherwise(F.col("o")).alias("b"), better.alias("moved")).select("source", "id", "b.cost", "b.via", "moved"))
        best, front = state.drop("moved"), state.where("moved").drop("moved")
        if not front.limit(1).count():
            return best


def reach_counts(paths: DataFrame, targets: DataFrame, limits: tuple[float, ...] = (5, 10, 15)) -> DataFrame:
    """Per source the number of targets (id; a repeated one counts each time) reached within each limit."""
    many = targets.groupBy("id").agg(F.count("*").alias("m"))
    hit = paths.join(many, "id")
    return hit.groupBy("source").agg(*[F.coalesce(F.sum(F.when(F.col("cost") <= k, F.col("m"))), F.lit(0)).alias(f"entro_{k:g}") for k in limits])


def catchment(paths: DataFrame, people: DataFrame, limits: tuple[float, ...] = (10, 15)) -> DataFrame:
    """Per source the people (id, pop) whose node is within each limit."""
    at = people.groupBy("id").agg(F.sum("pop").alias("pop"))
    return paths.join(at, "id").groupBy("source").agg(*[F.coalesce(F.sum(F.when(F.col("cost") <= k, F.col("pop"))), F.lit(0)).alias(f"pop_{k:g}") for k in limits])


def nearest_node(points: DataFrame, nodes: DataFrame, cell: float, most: float | None = None) -> DataFrame:
    """(id, node, metri): nearest node (node, ord, x, y) of each point (id, x, y), the first in order on ties.

    Rings of grid cells around each point are searched outwards until a node is nearer than the ring; the few points
    still open after a round go on to a ring of twice the width, up to ``most`` if given.
    """
    open_points, out, size = points.select("id", "x", "y"), None, cell
    while True:
        c = F.lit(float(size))
        of = lambda v: F.floor(F.col(v) / c)  # noqa: B023, E731
        grid = nodes.select("node", "ord", F.col("x").alias("nx"), F.col("y").alias("ny")).withColumn("cx", F.floor(F.col("nx") / c)).withColumn("cy", F.floor(F.col("ny") / c))
        around = open_points.withColumn("k", F.explode(F.array(*[F.struct((of("x") + i).alias("cx"), (of("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
        near = around.select("id", "x", "y", "k.*").join(grid, ["cx", "cy"]).withColumn("d", F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))).where(F.col("d") <= size)
        found = stage(near.groupBy("id").agg(F.min(F.struct("d", "ord", "node")).alias("m")).select("id", F.col("m.node").alias("node"), F.col("m.d").alias("metri")))
        out = found if out is None else out.unionByName(found)
        open_points = stage(open_points.join(found, "id", "left_anti"))
        if not open_points.limit(1).count() or not nodes.limit(1).count() or (most is not None and size >= most):
            break
        size *= 2
    return out if most is None else out.where(F.col("metri") <= most)


def best_stop_of_node(stops: DataFrame) -> DataFrame:
    """(node, stop_id): the stop with the most passages of each node, the smaller id on ties."""
    return stops.groupBy("node").agg(F.max_by("stop_id", F.struct("passaggi", -F.col("ord"))).alias("stop_id"))


def slope_penalty(minutes: Column, flat_minutes: Column) -> Column:
    """By how many percent a walk takes longer than on the flat, rounded half-even; null for no flat time."""
    return F.bround((F.try_divide(minutes, flat_minutes) - 1) * 100, 0)


def network_statistics(edges: DataFrame) -> DataFrame:
    """One row over edges (d, grade, kmh, t in minutes): km, mean grade, median of its size, mean speed, hours.

    The median comes from counts of distinct values by range buckets (``exact_quantiles``).
    """
    sums = edges.agg((F.sum("d") / 1000).alias("km"), F.avg("grade").alias("pendenza_media"), F.avg("kmh").alias("velocita_media"), (F.sum("t") / 60).alias("ore"))
    middle = exact_quantiles(edges.select(F.abs("grade").alias("v")), ["v"], (0.5,))
    return sums.crossJoin(F.broadcast(middle.select(F.col("v")[0].alias("pendenza_mediana"))))


def edge_times(edges: DataFrame, times: DataFrame) -> DataFrame:
    """(src, dst, media): mean of the times (id, t) of an edge's two ends."""
    a, b = times.select(F.col("id").alias("src"), F.col("t").alias("ta")), times.select(F.col("id").alias("dst"), F.col("t").alias("tb"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", ((F.col("ta") + F.col("tb")) / 2).alias("media"))
