"""Timetables: active services, passages and headways per stop, line lists, route relations, merging of stops."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import route_name, weekday
from ..functions.geometry import distance_to, within
from ..runtime import stage
from .components import connected_components
from .nearby import within_distance

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def active_services(calendar: DataFrame, exceptions: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, service_id) active on each of ``dates`` (date as yyyymmdd text).

    The calendar (service_id, start_date, end_date, monday ... sunday) counts within its closed span on its weekdays;
    exceptions (service_id, date, exception_type) of type 1 add and then of type 2 take away.
    """
    # Services meet dates by weekday, so neither side has to be small.
    days = dates.select("date").distinct().withColumn("day", weekday(F.to_date("date", "yyyyMMdd")))
    runs = F.explode(F.filter(F.array(*[F.when(F.col(d).cast("string") == "1", d) for d in WEEKDAYS]), lambda d: d.isNotNull()))
    regular = calendar.select("service_id", "start_date", "end_date", runs.alias("day")).join(days, "day").where((F.col("date") >= F.col("start_date")) & (F.col("date") <= F.col("end_date"))).select("date", "service_id")
    on = exceptions.join(dates.select("date").distinct(), "date", "left_semi")
    kind = lambda k: on.where(F.col("exception_type").cast("string") == k).select("date", "service_id")
    return regular.unionByName(kind("1")).distinct().join(kind("2"), ["date", "service_id"], "left_anti")


def common_weekday(services: Sequence[DataFrame], first: str, days: int = 31) -> DataFrame:
    """(date): the first Monday-to-Friday date within ``days`` of ``first`` on which every feed has a service."""
    spark = services[0].sparkSession
    span = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first), "yyyyMMdd"), F.date_add(F.to_date(F.lit(first), "yyyyMMdd"), days - 1))).alias("d")).where(F.weekday("d") < 5).select(F.date_format("d", "yyyyMMdd").alias("date"))
    for s in services:
        span = span.join(s.select("date").distinct(), "date", "left_semi")
    return span.agg(F.min("date").alias("date"))


def stop_passages(stop_times: DataFrame, start_s: float, end_s: float, keys: Sequence[str] = ("stop_id",), seconds: str = "seconds", line: str = "line") -> DataFrame:
    """Passages, first and last second, mean headway in minutes and sorted line list per key, times within [start, end]."""
    inside = stop_times.where(F.col(seconds).between(start_s, end_s))
    named = F.when(F.trim(line) != "", F.trim(line))
    each = inside.groupBy(*keys).agg(F.count("*").alias("passaggi"), F.min(seconds).alias("prima_s"), F.max(seconds).alias("ultima_s"), F.array_join(F.array_sort(F.collect_set(named)), ",").alias("linee"))
    return each.withColumn("frequenza_media_min", F.when(F.col("passaggi") > 1, (F.col("ultima_s") - F.col("prima_s")) / 60 / (F.col("passaggi") - 1)))


def lines_by_section(stops: DataFrame, sections: DataFrame, feeds: Sequence[str]) -> DataFrame:
    """Per section: for each feed the sorted line names joined by " | " and the number of stops; none as "" and 0."""
    each = stops.withColumn("line", F.explode_outer(F.split("linee", ",")))
    aggs = []
    for f in feeds:
        here = F.col("feed") == f
        aggs += [F.array_join(F.array_sort(F.collect_set(F.when(here & (F.trim("line") != ""), F.trim("line")))), " | ").alias(f"linee_{f}"), F.count_distinct(F.when(here, F.col("stop_id"))).alias(f"fermate_{f}")]
    out = sections.select("section_id").join(each.groupBy("section_id").agg(*aggs), "section_id", "left")
    return out.fillna({**{f"linee_{f}": "" for f in feeds}, **{f"fermate_{f}": 0 for f in feeds}})


def route_relation(crosses: Column, inner_stop: Column, outer_stop: Column) -> Column:
    """How a route relates to the boundary; null flags count as false."""
    c, i, o = (F.coalesce(x, F.lit(False)) for x in (crosses, inner_stop, outer_stop))
    return F.when(c & i, "attraversa_con_fermata_interna").when(c, "attraversa_senza_fermata_interna").when(i, "fermata_interna").when(o, "solo_fermata_esterna_accessibile").otherwise("non_pertinente")


def service_kind(urban: Column, extra: Column) -> Column:
    """Kind of service by passages of the two feeds."""
    return F.when((urban > 0) & (extra > 0), "misto").when(urban > 0, "urbano").when(extra > 0, "extraurbano").otherwise("")


def routes_near(stops: DataFrame, stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Routes that serve one of ``stops``: semi-joins down the chain, route ids once."""
    served = stop_times.join(stops.select("stop_id"), "stop_id", "left_semi").select("trip_id")
    return trips.join(served, "trip_id", "left_semi").select("route_id").distinct()


def trip_lines(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """(trip_id, line): the stops' points in order of stop_sequence, where a trip has at least two."""
    at = stop_times.join(stops, "stop_id").groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(F.col("stop_sequence").cast("int").alias("seq"), "x", "y"))).alias("p"))
    return at.where(F.size("p") >= 2).select("trip_id", F.transform("p", lambda p: F.struct(p["x"], p["y"])).alias("line"))


#: Stops of one chain that are merged in one task; longer chains are merged by rounds over all tasks.
CHAIN_STOPS = 50_000


def merge_stops(stops: DataFrame, metres: float = 35.0, chain_stops: int = CHAIN_STOPS) -> DataFrame:
    """(id, cluster): stops (id bigint, ord bigint, x, y in metres) merged greedily around seeds in order of ``ord``.

    The first free stop in order is a seed and takes every free stop within ``metres`` of it; clusters are numbered by
    their seed's order. That is sequential only among stops linked by chains of near stops: pairs within reach come
    from a grid of cells and connected components keep such chains apart. A chain of up to ``chain_stops`` is merged in
    one task. In longer ones a stop becomes a seed once all earlier stops near it are taken, round by round.
    """
    cell = F.lit(float(metres))
    spots = stops.select("id", "ord", F.col("x").cast("double"), F.col("y").cast("double"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    around = spots.select("ord", "id", "x", "y", F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")).select(F.col("id").alias("b"), F.col("ord").alias("bo"), F.col("x").alias("bx"), F.col("y").alias("by"), "c.cx", "c.cy")
    near = stage(spots.join(around, ["cx", "cy"]).where((F.col("ord") <= F.col("bo")) & ((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2 <= metres**2)).select(F.col("id").alias("a"), F.col("ord").alias("ao"), "b", "bo"))
    groups = connected_components(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    size = groups.groupBy("component").agg(F.count("*").alias("n"))
    sized = stage(groups.join(size, "component"))

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ord", kind="stable")
        x, y, free = g["x"].to_numpy(), g["y"].to_numpy(), np.ones(len(g), bool)
        seed = np.full(len(g), -1, np.int64)
        for i in range(len(g)):
            if free[i]:
                mine = free & ((x - x[i]) ** 2 + (y - y[i]) ** 2 <= metres**2)
                seed[mine] = g["ord"].iloc[i]
                free[mine] = False
        return pd.DataFrame({"id": g["id"].to_numpy(), "seed": seed})

    short = sized.where(F.col("n") <= chain_stops).select("id", "component")
    merged = spots.select("id", "ord", "x", "y").join(short, "id").groupBy("component").applyInPandas(merge, "id bigint, seed bigint").select("id", F.col("seed").alias("cluster"))
    long = sized.where(F.col("n") > chain_stops).select("id")
    if not long.limit(1).count():
        return merged
    pairs = stage(near.join(long.select(F.col("id").alias("a")), "a", "left_semi"))
    free = stage(pairs.where("a = b").select(F.col("a").alias("id"), F.col("ao").alias("ord")))
    done, seeds = None, None
    while free.limit(1).count():
        # Free stops without an earlier free stop near them are seeds from now on; seeds take the free stops near them.
        of_free = pairs.join(free.select(F.col("id").alias("b")), "b", "left_semi")
        both_free = of_free.join(free.select(F.col("id").alias("a")), "a", "left_semi")
        fresh = both_free.groupBy("b").agg(F.min("ao").alias("first"), F.max(F.when(F.col("a") == F.col("b"), F.col("bo"))).alias("own")).where("first = own").select(F.col("b").alias("a"))
        # A stop near an earlier seed that it still waited for isn't fresh: it has a taker already.
        if seeds is not None:
            fresh = fresh.join(of_free.join(seeds, "a", "left_semi").select(F.col("b").alias("a")), "a", "left_anti")
        seeds = stage(fresh if seeds is None else seeds.unionByName(fresh))
        takers = of_free.join(seeds, "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("ao").alias("cluster"))
        # While an undecided stop comes before the taker, it may become the taker instead.
        waits = both_free.where("a <> b").join(seeds, "a", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min("ao").alias("undecided"))
        taken = stage(takers.join(waits, "id", "left").where(F.col("undecided").isNull() | (F.col("cluster") < F.col("undecided"))).select("id", "cluster"))
        done = taken if done is None else done.unionByName(taken)
        free = stage(free.join(taken, "id", "left_anti"))
    return merged.unionByName(done)


def cluster_summary(members: DataFrame) -> DataFrame:
    """Per cluster: the longest name (first in order on ties), members, passages by feed, centre of the distinct points."""
    longest = F.max_by("stop_name", F.struct(F.length("stop_name"), -F.col("ord")))
    sums = members.groupBy("cluster").agg(longest.alias("stop_name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"].cast("string")), ",").alias("stop_ids"), F.sum(F.when(F.col("feed") == "urbano", F.col("passaggi")).otherwise(0)).alias("passaggi_urbani"), F.sum(F.when(F.col("feed") == "extraurbano", F.col("passaggi")).otherwise(0)).alias("passaggi_extraurbani"))
    centres = members.select("cluster", "x", "y").distinct().groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return sums.join(centres, "cluster").withColumn("tipo_servizio", service_kind(F.col("passaggi_urbani"), F.col("passaggi_extraurbani")))


def stops_within(stops: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """Stops (id, lat, lon) within ``metres`` of places (id, lat, lon): (stop, place, metri)."""
    near = within_distance(stops, places, metres)
    return near.select(F.col("left_id").alias("stop"), F.col("right_id").alias("place"), "metri")


def routed_stop_times(stop_times: DataFrame, trips: DataFrame, columns: Sequence[str] = ("route_id",)) -> DataFrame:
    """Stop times with ``columns`` of their trip; times of unknown trips are left out."""
    return stop_times.join(trips.select("trip_id", *columns), "trip_id")


def route_shapes(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """(route_id, shape_id, line): the distinct shapes of each route, points in order of shape_pt_sequence.

    Lines are built once per shape and joined to the distinct (route, shape) pairs of the trips, so a shape that very
    many trips run isn't built again.
    """
    lines = shapes.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct(F.col("shape_pt_sequence").cast("int").alias("seq"), "x", "y"))).alias("p"))
    lines = lines.where(F.size("p") >= 2).select("shape_id", F.transform("p", lambda p: F.struct(p["x"], p["y"])).alias("line"))
    return trips.select("route_id", "shape_id").where(F.col("shape_id").isNotNull()).distinct().join(lines, "shape_id").select("route_id", "shape_id", "line")


def counts_with_stops(counts: DataFrame, stops: DataFrame) -> DataFrame:
    """Counts (stop_id, ..) with the attributes of their stop, null where the stop is unknown."""
    return counts.join(stops.dropDuplicates(["stop_id"]), "stop_id", "left")


def joined_by_position(sections: DataFrame, *others: DataFrame, position: str = "section_index") -> DataFrame:
    """Sections with the columns of tables that belong to them by position; sections without a row keep nulls."""
    for o in others:
        sections = sections.join(o, position, "left")
    return sections


def chosen_routes(routes: DataFrame, wanted: Sequence[str], name: str = "route_short_name") -> DataFrame:
    """Routes whose normalised short name is among ``wanted``; raises with the names there are if none is."""
    of = route_name(F.col(name).cast("string"))
    names = [w.strip().upper().removesuffix(".0") for w in wanted]
    found = routes.where(of.isin(names))
    if not found.limit(1).count():
        there = [r[0] for r in routes.select(of.alias("n")).where("n is not null").distinct().orderBy("n").limit(100).collect()]
        raise ValueError(f"none of {names}; there are {there}")
    return found


def relevant_lines(lines: DataFrame) -> DataFrame:
    """Lines that cross the boundary or have a stop inside it; null flags count as false."""
    return lines.where(F.coalesce("crosses", F.lit(False)) | F.coalesce("inner_stop", F.lit(False)))


def relevant_stops(stops: DataFrame, ring: Column, metres: float) -> DataFrame:
    """Stops (.., x, y) inside the boundary or within ``metres`` outside it, with ``interna``."""
    marked = stops.withColumn("interna", within(ring, F.col("x"), F.col("y"))).withColumn("__far", distance_to(ring, F.col("x"), F.col("y")))
    return marked.where(F.col("interna") | (F.col("__far") <= metres)).drop("__far")


def cluster_headways(members: DataFrame, feeds: Sequence[str] = ("urbano", "extraurbano")) -> DataFrame:
    """Per cluster of stops (cluster, feed, frequenza) the least headway by feed, null without one."""
    return members.groupBy("cluster").agg(*[F.min(F.when(F.col("feed") == f, F.col("frequenza"))).alias(f"frequenza_{f}") for f in feeds])


def dissolve_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, segmenti, metri): the union of the lines (array of points) of each key combination as its distinct segments.

    Every line is cut into its segments, turned one way, and segments are made distinct before they are gathered, so a
    street that very many lines follow counts once.
    """
    a, b = F.slice("line", F.lit(1), F.greatest(F.size("line") - 1, F.lit(0))), F.slice("line", F.lit(2), F.greatest(F.size("line") - 1, F.lit(0)))
    pieces = lines.select(*keys, F.explode(F.zip_with(a, b, lambda p, q: F.array_sort(F.array(p, q)))).alias("s")).distinct()
    pieces = pieces.withColumn("m", F.hypot(F.col("s")[1]["x"] - F.col("s")[0]["x"], F.col("s")[1]["y"] - F.col("s")[0]["y"]))
    return pieces.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("segmenti"), F.sum("m").alias("metri"))


def with_route_info(dissolved: DataFrame, info: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dissolved lines with the route facts of their keys; each combination of facts once."""
    return dissolved.join(info.distinct(), list(keys), "left")


def end_stops(sections: DataFrame, stops: DataFrame, ends: Sequence[str] = ("origine", "destinazione")) -> DataFrame:
    """Sections with name, minutes and service of the stop cluster at each end; '', null and false where there is none."""
    for e in ends:
        at = stops.select(F.col("cluster").alias(f"cluster_{e}"), F.col("stop_name").alias(f"nome_{e}"), F.col("frequenza").alias(f"frequenza_{e}"), F.col("urbana").alias(f"urbana_{e}"))
        sections = sections.join(at, f"cluster_{e}", "left").withColumn(f"nome_{e}", F.coalesce(f"nome_{e}", F.lit(""))).withColumn(f"urbana_{e}", F.coalesce(f"urbana_{e}", F.lit(False)))
    return sections


def internal_lines(sections: DataFrame, lines: DataFrame, feeds: Sequence[str] = ("urbano", "extraurbano")) -> DataFrame:
    """Sections with one sorted distinct list of the internal lines (feed, line, inner_stop) of each feed, the same on all.

    The lists are one row; line names number as many as a timetable has.
    """
    inner = lines.where(F.coalesce("inner_stop", F.lit(False)) & (F.trim("line") != ""))
    lists = inner.agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col("feed") == f, F.trim("line")))), " | ").alias(f"linee_interne_{f}") for f in feeds])
    return sections.crossJoin(F.broadcast(lists))


def density_of_union(sections: DataFrame) -> DataFrame:
    """(gruppo, abitanti, area_m2, densita): people per hectare over the whole area of the sections (gruppo, pop, area_m2)."""
    return sections.groupBy("gruppo").agg(F.sum("pop").alias("abitanti"), F.sum("area_m2").alias("area_m2")).withColumn("densita", F.try_divide(F.col("abitanti"), F.col("area_m2") / 10_000))
