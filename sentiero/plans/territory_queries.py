"""Queries of the timetable chain, the walking network, rasters, regions and plain expressions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import geometry as G
from ..operators import facets, graph, joins, matching, nearby, ranking, raster, transit
from ..runtime import table
from .core_queries import _GRID, query

# --- Timetable chain -------------------------------------------------------------------------------------------------


def _trips(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 40).alias("route_id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") % 120).alias("shape_id"))


_TRIPS = "(SELECT o_orderkey AS trip_id, o_custkey % 40 AS route_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 120 END AS shape_id FROM orders)"
_SHAPES = "(SELECT p_partkey % 90 AS shape_id, p_partkey AS shape_pt_sequence, CAST(p_partkey % 17 AS DOUBLE) AS x, CAST(p_partkey % 13 AS DOUBLE) AS y FROM part)"


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, d, "part").select((p % 90).alias("shape_id"), p.alias("shape_pt_sequence"), (p % 17).cast("double").alias("x"), (p % 13).cast("double").alias("y"))


@query(f"""SELECT route_id, count(*) AS passaggi, count(DISTINCT trip_id) AS corse FROM lineitem JOIN {_TRIPS} ON l_orderkey = trip_id GROUP BY route_id""")
def stop_times_of_routes(spark: SparkSession, d: str) -> DataFrame:
    """Stop times joined to their trips and counted by route."""
    times = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"))
    return transit.routed_stop_times(times, _trips(spark, d)).groupBy("route_id").agg(F.count("*").alias("passaggi"), F.count_distinct("trip_id").alias("corse"))


@query(f"""WITH s AS (SELECT shape_id, count(*) AS punti, arg_min(x, shape_pt_sequence) AS x0, arg_max(y, shape_pt_sequence) AS y1 FROM {_SHAPES} GROUP BY shape_id HAVING count(*) >= 2)
SELECT DISTINCT route_id, shape_id, punti, x0, y1 FROM {_TRIPS} JOIN s USING (shape_id)""")
def shapes_of_routes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct shapes of routes with their ordered points."""
    r = transit.route_shapes(_trips(spark, d), _shapes(spark, d))
    return r.select("route_id", "shape_id", F.size("line").cast("bigint").alias("punti"), F.col("line")[0]["x"].alias("x0"), F.element_at("line", -1)["y"].alias("y1"))


@query("""WITH c AS (SELECT l_suppkey * 2 AS stop_id, count(*) AS passaggi FROM lineitem GROUP BY l_suppkey) SELECT stop_id, passaggi, s_name AS nome, s_nationkey AS zona FROM c LEFT JOIN supplier ON s_suppkey = stop_id""")
def counts_with_stops(spark: SparkSession, d: str) -> DataFrame:
    """Passage counts with the attributes of their stop, unknown stops kept."""
    counts = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") * 2).alias("stop_id")).agg(F.count("*").alias("passaggi"))
    return transit.counts_with_stops(counts, table(spark, d, "supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("nome"), F.col("s_nationkey").alias("zona")))


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY c_custkey) AS section_index, c_custkey FROM customer), a AS (SELECT o_custkey AS section_index, sum(o_totalprice) AS accesso FROM orders GROUP BY o_custkey), l AS (SELECT s_suppkey AS section_index, s_name AS linea FROM supplier)
SELECT section_index, c_custkey, round_even(accesso, 2) AS accesso, linea FROM s LEFT JOIN a USING (section_index) LEFT JOIN l USING (section_index)""")
def sections_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Running numbers as positions, and tables joined by them."""
    s = ranking.surrogate_ids(table(spark, d, "customer").select("c_custkey"), "c_custkey", "section_index")
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("section_index")).agg(F.bround(F.sum("o_totalprice"), 2).alias("accesso"))
    return transit.joined_by_position(s, a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("section_index"), F.col("s_name").alias("linea")))


@query("""SELECT c_custkey, 'SEZ-' || lpad(CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR), 8, '0') AS codice FROM customer""")
def surrogate_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes with a running number in key order."""
    return ranking.surrogate_ids(table(spark, d, "customer").select("c_custkey"), "c_custkey", "codice", "SEZ-", 8)


@query("""SELECT route_id, route_short_name, pertinente FROM linee_gtfs_classificate WHERE regexp_replace(upper(trim(route_short_name)), '\\.0$', '') IN (SELECT regexp_replace(upper(trim(route_short_name)), '\\.0$', '') FROM linee_gtfs_classificate WHERE interseca_confine)""")
def chosen_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes on a list of names, which must not be empty of known ones."""
    r = table(spark, d, "linee_gtfs_classificate")
    wanted = [x[0] for x in r.where("interseca_confine").select("route_short_name").distinct().collect()]  # 58 lines at most
    return transit.chosen_routes(r, wanted).select("route_id", "route_short_name", "pertinente")


@query("""SELECT c_custkey, n FROM (SELECT o_custkey AS c_custkey, bool_or(o_totalprice > 300000) AS a, bool_or(o_orderstatus = 'P') AS b, count(*) AS n FROM orders GROUP BY 1) WHERE a OR b""")
def relevant_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that cross the boundary or stop inside it."""
    lines = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_totalprice") > 300000).alias("crosses"), F.bool_or(F.col("o_orderstatus") == "P").alias("inner_stop"), F.count("*").alias("n"))
    return transit.relevant_lines(lines).select("c_custkey", "n")


@query("""WITH s AS (SELECT p_partkey, CAST(p_partkey % 41 AS DOUBLE) AS x, CAST(p_partkey % 37 AS DOUBLE) AS y FROM part)
SELECT p_partkey, x > 10 AND x < 20 AND y > 10 AND y < 20 AS interna FROM s WHERE sqrt(pow(greatest(10 - x, 0, x - 20), 2) + pow(greatest(10 - y, 0, y - 20), 2)) <= 5""")
def relevant_stops(spark: SparkSession, d: str) -> DataFrame:
    """Stops inside a boundary or in the buffer around it."""
    p = F.col("p_partkey")
    stops = table(spark, d, "part").select("p_partkey", (p % 41).cast("double").alias("x"), (p % 37).cast("double").alias("y"))
    ring = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((10, 10), (20, 10), (20, 20), (10, 20))])
    return transit.relevant_stops(stops, ring, 5.0).select("p_partkey", "interna")


@query("""SELECT s_nationkey AS cluster, min(s_acctbal) FILTER (s_suppkey % 2 = 0) AS frequenza_urbano, min(s_acctbal) FILTER (s_suppkey % 2 = 1) AS frequenza_extraurbano FROM supplier GROUP BY s_nationkey""")
def cluster_headways(spark: SparkSession, d: str) -> DataFrame:
    """Least headway of merged stops by feed."""
    m = table(spark, d, "supplier").select(F.col("s_nationkey").alias("cluster"), F.when(F.col("s_suppkey") % 2 == 0, "urbano").otherwise("extraurbano").alias("feed"), F.col("s_acctbal").alias("frequenza"))
    return transit.cluster_headways(m)


_LINES = """(SELECT o_orderkey, o_orderpriority AS linea, o_orderstatus AS feed, CAST(o_custkey % 20 AS DOUBLE) AS x, CAST(o_orderkey % 20 AS DOUBLE) AS y FROM orders)"""


@query(f"""WITH s AS (SELECT linea, feed, x, y, 1 AS k FROM {_LINES} UNION SELECT linea, feed, x + 1, y, 2 FROM {_LINES}), i AS (SELECT DISTINCT linea, feed, linea LIKE '1%' AS urgente FROM {_LINES}),
g AS (SELECT linea, feed, count(*) AS segmenti, CAST(count(*) AS DOUBLE) AS metri FROM (SELECT DISTINCT linea, feed, CASE WHEN k = 1 THEN x ELSE x END AS x, y, k FROM s) GROUP BY linea, feed) SELECT linea, feed, segmenti, metri, urgente FROM g LEFT JOIN i USING (linea, feed)""")
def dissolved_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines united by their keys as distinct segments, with the facts of their route."""
    o = table(spark, d, "orders")
    x, y = (F.col("o_custkey") % 20).cast("double"), (F.col("o_orderkey") % 20).cast("double")
    lines = o.select(F.col("o_orderpriority").alias("linea"), F.col("o_orderstatus").alias("feed"), F.when(F.col("o_orderkey") % 2 == 0, F.array(G.point(x, y), G.point(x + 1, y), G.point(x + 1, y + 1))).otherwise(F.array(G.point(x + 1, y + 1), G.point(x + 1, y), G.point(x, y))).alias("line"))
    info = lines.select("linea", "feed", F.col("linea").startswith("1").alias("urgente"))
    united = transit.with_route_info(transit.dissolve_lines(lines, ["linea", "feed"]), info, ["linea", "feed"])
    return united.select("linea", "feed", F.size("segmenti").cast("bigint").alias("segmenti"), "metri", "urgente")


@query("""WITH st AS (SELECT s_suppkey AS k, s_name AS n, s_acctbal AS f, s_nationkey < 12 AS u FROM supplier)
SELECT c_custkey, coalesce(a.n, '') AS nome_origine, a.f AS frequenza_origine, coalesce(a.u, false) AS urbana_origine, coalesce(b.n, '') AS nome_destinazione, b.f AS frequenza_destinazione, coalesce(b.u, false) AS urbana_destinazione
FROM customer LEFT JOIN st a ON a.k = c_custkey LEFT JOIN st b ON b.k = c_custkey // 2""")
def end_stops(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of the stop cluster at either end, defaults where there is none."""
    sections = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("cluster_origine"), F.floor(F.col("c_custkey") / 2).alias("cluster_destinazione"))
    stops = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cluster"), F.col("s_name").alias("stop_name"), F.col("s_acctbal").alias("frequenza"), (F.col("s_nationkey") < 12).alias("urbana"))
    return transit.end_stops(sections, stops).drop("cluster_origine", "cluster_destinazione")


@query("""SELECT n_nationkey, (SELECT string_agg(DISTINCT trim(route_short_name), ' | ' ORDER BY trim(route_short_name)) FROM linee_gtfs_classificate WHERE pertinente AND feed_source LIKE '%extra%') AS extra, (SELECT string_agg(DISTINCT trim(route_short_name), ' | ' ORDER BY trim(route_short_name)) FROM linee_gtfs_classificate WHERE pertinente AND feed_source NOT LIKE '%extra%') AS urbane FROM nation""")
def internal_line_lists(spark: SparkSession, d: str) -> DataFrame:
    """One list of internal lines by feed on every section."""
    lines = table(spark, d, "linee_gtfs_classificate").select(F.when(F.col("feed_source").contains("extra"), "extraurbano").otherwise("urbano").alias("feed"), F.col("route_short_name").alias("line"), F.col("pertinente").alias("inner_stop"))
    out = transit.internal_lines(table(spark, d, "nation").select("n_nationkey"), lines)
    return out.select("n_nationkey", F.nullif("linee_interne_extraurbano", F.lit("")).alias("extra"), F.nullif("linee_interne_urbano", F.lit("")).alias("urbane"))


@query("""SELECT c_nationkey AS gruppo, CAST(sum(c_custkey) AS DOUBLE) AS abitanti, CAST(sum(c_custkey % 7) AS DOUBLE) * 1000 AS area_m2, round_even(sum(c_custkey) / (sum(c_custkey % 7) * 0.1), 6) AS densita FROM customer GROUP BY c_nationkey""")
def union_density(spark: SparkSession, d: str) -> DataFrame:
    """People per hectare over the united area."""
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("gruppo"), F.col("c_custkey").cast("double").alias("pop"), (F.col("c_custkey") % 7 * 1000).cast("double").alias("area_m2"))
    return transit.density_of_union(s).withColumn("densita", F.bround("densita", 6))


@query("""SELECT stop_cluster_id, CASE WHEN passaggi_urbani > 0 AND passaggi_extraurbani > 0 THEN 'misto' WHEN passaggi_urbani > 0 THEN 'urbano' WHEN passaggi_extraurbani > 0 THEN 'extraurbano' ELSE '' END AS tipo FROM (SELECT DISTINCT stop_cluster_id, passaggi_urbani, passaggi_extraurbani FROM fermate_gtfs_aggregate)""")
def service_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kind of service by the passages of two feeds (P10)."""
    a = table(spark, d, "fermate_gtfs_aggregate").select("stop_cluster_id", "passaggi_urbani", "passaggi_extraurbani").distinct()
    return a.select("stop_cluster_id", transit.service_kind(F.col("passaggi_urbani"), F.col("passaggi_extraurbani")).alias("tipo"))


@query("""WITH a AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS d FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT strftime(l_shipdate, '%Y%m%d') AS d FROM lineitem WHERE l_returnflag = 'R')
SELECT min(d) AS date FROM a JOIN b USING (d) WHERE d BETWEEN '19950603' AND '19950703' AND isodow(strptime(d, '%Y%m%d')) <= 5""")
def common_weekday(spark: SparkSession, d: str) -> DataFrame:
    """First weekday of a month on which both feeds run (F8)."""
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.date_format("o_orderdate", "yyyyMMdd").alias("date"))
    b = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.date_format("l_shipdate", "yyyyMMdd").alias("date"))
    return transit.common_weekday([a, b], "19950603")


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS quando, user_id, event_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value > 0 ORDER BY ts, event_id LIMIT 500""")
def first_by_time(spark: SparkSession, d: str) -> DataFrame:
    """Members of a set of kinds with a positive value, the first by time."""
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase") & (F.col("value") > 0))
    return e.orderBy("ts", "event_id").limit(500).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("quando"), "user_id", "event_id")


@query("""SELECT event_type, user_id, event_id, CAST(row_number() OVER (ORDER BY event_type, ts, event_id) AS BIGINT) AS posto FROM events ORDER BY event_type, ts, event_id LIMIT 400""")
def first_by_kind_and_time(spark: SparkSession, d: str) -> DataFrame:
    """The first rows by kind and then time, with their place."""
    first = table(spark, d, "events").orderBy("event_type", "ts", "event_id").limit(400)
    # The limit bounds what is numbered in one task.
    return first.withColumn("posto", F.row_number().over(Window.orderBy("event_type", "ts", "event_id")).cast("bigint")).select("event_type", "user_id", "event_id", "posto")


@query("""WITH c AS (SELECT trim(mapcategory) AS v, count(*) AS n FROM cultura_socialita_e_spazi_comuni WHERE trim(mapcategory) <> '' GROUP BY 1) SELECT v, n FROM c""")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by value, most frequent first and by Italian collation on ties."""
    return facets.collated_counts(table(spark, d, "cultura_socialita_e_spazi_comuni").select(F.trim("mapcategory").alias("v")).where("v <> ''"), "v")


@query("""SELECT feed, count(*) AS fermate, count(nome) AS con_nome FROM (SELECT 'a' AS feed, s_suppkey AS id, s_name AS nome FROM supplier UNION ALL SELECT 'b', n_nationkey, NULL FROM nation) GROUP BY feed""")
def union_of_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Feeds put together by column name, missing columns null; keys that both have."""
    a = table(spark, d, "supplier").select(F.lit("a").alias("feed"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("nome"))
    b = table(spark, d, "nation").select(F.lit("b").alias("feed"), F.col("n_nationkey").cast("bigint").alias("id"))
    both = joins.shared_columns(a, b)
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy(*[c for c in both if c == "feed"]).agg(F.count("*").alias("fermate"), F.count("nome").alias("con_nome"))


# --- Walking network --------------------------------------------------------------------------------------------------

_STREETS = "(SELECT p_partkey AS line_id, CAST(p_partkey % 50 AS DOUBLE) * 100 AS xa, CAST(p_partkey // 50 AS DOUBLE) * 100 AS ya, CAST(p_partkey % 50 AS DOUBLE) * 100 + p_size * 8 AS xb, CAST(p_partkey // 50 AS DOUBLE) * 100 + p_size * 6 AS yb, p_size FROM part)"


def _streets(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    x, y = (p % 50).cast("double") * 100, F.floor(p / 50).cast("double") * 100
    return table(spark, d, "part").select(p.alias("line_id"), x.alias("xa"), y.alias("ya"), (x + F.col("p_size") * 8).alias("xb"), (y + F.col("p_size") * 6).alias("yb"), "p_size")


@query(f"""WITH l AS (SELECT *, p_size * 10.0 AS len FROM {_STREETS}), n AS (SELECT *, greatest(2, CAST(floor(len / 25) AS INT) + 1) AS n FROM l), p AS (SELECT line_id, unnest(generate_series(0, n - 1)) AS seq, n, xa, ya, xb, yb FROM n)
SELECT line_id, seq, round_even(xa + (xb - xa) * seq / (n - 1), 6) AS x, round_even(ya + (yb - ya) * seq / (n - 1), 6) AS y FROM p""")
def densified_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines as equally spaced points (G1)."""
    lines = _streets(spark, d).select("line_id", F.array(G.point(F.col("xa"), F.col("ya")), G.point(F.col("xb"), F.col("yb"))).alias("line"))
    return graph.densify(lines).select("line_id", "seq", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"))


_SEGMENTS = f"(SELECT xa AS x1, ya AS y1, CAST(line_id % 23 AS DOUBLE) AS z1, xb AS x2, yb AS y2, CASE WHEN line_id % 9 <> 0 THEN CAST(line_id % 31 AS DOUBLE) END AS z2, line_id % 5 = 0 AS stairs, p_size * 10.0 AS d FROM {_STREETS} WHERE p_size > 0)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("line_id")
    return _streets(spark, d).select(F.col("xa").alias("x1"), F.col("ya").alias("y1"), (i % 23).cast("double").alias("z1"), F.col("xb").alias("x2"), F.col("yb").alias("y2"), F.when(i % 9 != 0, (i % 31).cast("double")).alias("z2"), (i % 5 == 0).alias("stairs"))


_EDGES = f"""WITH s AS (SELECT printf('%.1f_%.1f', x1, y1) AS u, printf('%.1f_%.1f', x2, y2) AS v, d, coalesce(z2 - z1, 0) / d AS slope, stairs FROM {_SEGMENTS}),
b AS (SELECT u AS src, v AS dst, slope, d, stairs FROM s UNION ALL SELECT v, u, -slope, d, stairs FROM s),
k AS (SELECT src, dst, d, CASE WHEN stairs THEN least(6 * exp(-3.5 * abs(slope + 0.05)), 1.8) ELSE 6 * exp(-3.5 * abs(slope + 0.05)) END AS kmh FROM b WHERE src <> dst),
e AS (SELECT src, dst, min(d / (kmh * 1000 / 60)) AS t, min(d) AS d FROM k GROUP BY src, dst)"""


@query(_EDGES + " SELECT src, dst, round_even(t, 6) AS t, round_even(d / 75.0, 6) AS t_flat, round_even((t / (d / 75.0) - 1) * 100, 0) + 0.0 AS penalita FROM e")
def walking_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges both ways with walking minutes by slope, slow stairs and the penalty against the flat."""
    e = graph.walking_edges(_segments(spark, d))
    return e.select("src", "dst", F.bround("t", 6).alias("t"), F.bround("t_flat", 6).alias("t_flat"), (graph.slope_penalty(F.col("t"), F.col("t_flat")) + 0.0).alias("penalita"))


@query(_EDGES + " SELECT round_even(sum(d) / 1000, 4) AS km, round_even(avg(d / t), 4) AS pendenza_media, round_even(avg(d / t * 0.06), 6) AS velocita_media, round_even(sum(t) / 60, 4) AS ore, round_even(median(d / t), 4) AS pendenza_mediana FROM e")
def network_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Length, means, median and hours of a network in one row."""
    e = graph.walking_edges(_segments(spark, d)).select("d", "t", (F.col("d") / F.col("t")).alias("grade"), (F.col("d") / F.col("t") * 0.06).alias("kmh"))
    s = graph.network_statistics(e)
    return s.select(F.bround("km", 4).alias("km"), F.bround("pendenza_media", 4).alias("pendenza_media"), F.bround("velocita_media", 6).alias("velocita_media"), F.bround("ore", 4).alias("ore"), F.bround("pendenza_mediana", 4).alias("pendenza_mediana"))


@query("""WITH r AS (SELECT c_custkey AS k, CAST(floor(sqrt(c_custkey)) AS BIGINT) AS g FROM customer), n AS (SELECT g, count(*) AS n FROM r GROUP BY g), best AS (SELECT g FROM n ORDER BY n DESC, g LIMIT 1)
SELECT k AS src, k + 1 AS dst FROM r WHERE g = (SELECT g FROM best) AND CAST(floor(sqrt(k + 1)) AS BIGINT) = g AND k + 1 IN (SELECT c_custkey FROM customer)""")
def largest_network(spark: SparkSession, d: str) -> DataFrame:
    """The largest weakly connected part of a graph of chains."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"))
    inside = c.join(table(spark, d, "customer").select(F.col("c_custkey").alias("dst")), "dst", "left_semi")
    return graph.largest_component(inside.where(F.floor(F.sqrt("src")) == F.floor(F.sqrt("dst"))).select("src", "dst"))


@query("""SELECT DISTINCT c_custkey AS src, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 3 = 0 THEN 7.0 END, CASE WHEN c_custkey % 2 = 0 THEN 12 / 1.2 END, 1.0) AS stima, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END, CAST('inf' AS DOUBLE)) = CAST('inf' AS DOUBLE) AS bloccato FROM customer""")
def repaired_weights(spark: SparkSession, d: str) -> DataFrame:
    """Missing walking times estimated, or blocked."""
    k = F.col("c_custkey")
    e = table(spark, d, "customer").select(k.alias("src"), F.when(k % 4 == 0, F.col("c_acctbal")).alias("walk_time_s"), F.when(k % 3 == 0, 7.0).alias("travel_time"), F.when(k % 2 == 0, 12.0).alias("length"))
    blocked = graph.repaired_weights(e, "block").select("src", (F.col("walk_time_s") == float("inf")).alias("bloccato"))
    return graph.repaired_weights(e).select("src", F.col("walk_time_s").alias("stima")).join(blocked, "src")


@query("""WITH n AS (SELECT s_suppkey AS node, CAST(s_suppkey % 10 AS DOUBLE) * 100 AS nx, CAST(s_suppkey // 10 AS DOUBLE) * 100 AS ny FROM supplier), p AS (SELECT c_custkey AS id, CAST(c_custkey % 53 AS DOUBLE) * 31 AS x, CAST(c_custkey % 47 AS DOUBLE) * 37 AS y FROM customer),
d AS (SELECT id, node, sqrt(pow(x - nx, 2) + pow(y - ny, 2)) AS m FROM p, n) SELECT id, node, round_even(m, 6) AS metri FROM d WHERE m <= 250 QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, node) = 1""")
def snapped_points(spark: SparkSession, d: str) -> DataFrame:
    """Nearest node within 250 m, none beyond."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    nodes = table(spark, d, "supplier").select(s.alias("node"), s.alias("ord"), ((s % 10) * 100).cast("double").alias("x"), (F.floor(s / 10) * 100).cast("double").alias("y"))
    points = table(spark, d, "customer").select(c.alias("id"), ((c % 53) * 31).cast("double").alias("x"), ((c % 47) * 37).cast("double").alias("y"))
    return graph.nearest_node(points, nodes, 62.5, 250.0).select("id", "node", F.bround("metri", 6).alias("metri"))


@query("""SELECT node, stop_id FROM (SELECT s_nationkey AS node, s_suppkey AS stop_id, s_suppkey % 7 AS passaggi FROM supplier) QUALIFY row_number() OVER (PARTITION BY node ORDER BY passaggi DESC, stop_id) = 1""")
def best_stops(spark: SparkSession, d: str) -> DataFrame:
    """The busiest stop of each node."""
    s = F.col("s_suppkey")
    return graph.best_stop_of_node(table(spark, d, "supplier").select(F.col("s_nationkey").alias("node"), s.alias("stop_id"), s.alias("ord"), (s % 7).alias("passaggi")))


@query("""SELECT o_orderkey AS src, o_custkey AS dst, (a.c_acctbal + b.c_acctbal) / 2 AS media FROM orders JOIN customer a ON a.c_custkey = o_orderkey JOIN customer b ON b.c_custkey = o_custkey""")
def edge_times(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the times at an edge's ends."""
    return graph.edge_times(table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")), table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("t")))


@query("""WITH p AS (SELECT s_nationkey AS source, n_nationkey AS id, CAST(abs(n_nationkey - s_nationkey) * 2 AS DOUBLE) AS cost FROM (SELECT DISTINCT s_nationkey FROM supplier), nation WHERE abs(n_nationkey - s_nationkey) <= 10), c AS (SELECT c_nationkey AS id, c_custkey % 5 AS pop FROM customer)
SELECT source, CAST(sum(CASE WHEN cost <= 10 THEN pop ELSE 0 END) AS BIGINT) AS pop_10, CAST(sum(CASE WHEN cost <= 15 THEN pop ELSE 0 END) AS BIGINT) AS pop_15 FROM p JOIN c USING (id) GROUP BY source""")
def catchments(spark: SparkSession, d: str) -> DataFrame:
    """People within walking limits of services, over a chain of nodes."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    chain = n.select(F.col("k").alias("src"), (F.col("k") + 1).alias("dst"), F.lit(2.0).alias("t")).where("dst < 25")
    seeds = table(spark, d, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_nationkey").alias("id"), F.lit(0.0).alias("cost")).distinct()
    paths = graph.shortest_paths(chain.unionByName(graph.reverse(chain)), seeds, cutoff=20.0)
    return graph.catchment(paths, table(spark, d, "customer").select(F.col("c_nationkey").alias("id"), (F.col("c_custkey") % 5).alias("pop")))


# --- Rasters ----------------------------------------------------------------------------------------------------------


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).alias("row"), (F.col("p_partkey") % 40).alias("col"), F.col("p_retailprice").alias("v"))


_GRADIENT = f"""WITH p AS ({_GRID}), g AS (SELECT a.r, a.c, a.v, e.v AS e, w.v AS w, s.v AS s, n.v AS n FROM p a LEFT JOIN p e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN p w ON w.r = a.r AND w.c = a.c - 1 LEFT JOIN p s ON s.r = a.r + 1 AND s.c = a.c LEFT JOIN p n ON n.r = a.r - 1 AND n.c = a.c),
z AS (SELECT r, c, CASE WHEN e IS NOT NULL AND w IS NOT NULL THEN (e - w) / 20 WHEN e IS NOT NULL THEN (e - v) / 10 WHEN w IS NOT NULL THEN (v - w) / 10 END AS dx, CASE WHEN s IS NOT NULL AND n IS NOT NULL THEN (s - n) / 20 WHEN s IS NOT NULL THEN (s - v) / 10 WHEN n IS NOT NULL THEN (v - n) / 10 END AS dy FROM g)"""


@query(_GRADIENT + """ SELECT r AS "row", c AS col, round_even(((90 - degrees(atan2(dy, -dx))) % 360 + 360) % 360, 6) AS esposizione, round_even(greatest(0, least(255, 255 * (sin(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + cos(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(135) - atan2(dy, -dx))))), 5) AS ombra FROM z WHERE dx IS NOT NULL AND dy IS NOT NULL""")
def aspect_and_shade(spark: SparkSession, d: str) -> DataFrame:
    """Compass direction of slopes and shaded relief."""
    g = raster.gradient(_pixels(spark, d), 10.0).where("dz_dx is not null and dz_dy is not null")
    return g.select("row", "col", F.bround(raster.aspect_degrees(F.col("dz_dx"), F.col("dz_dy")), 6).alias("esposizione"), F.bround(raster.hillshade(F.col("dz_dx"), F.col("dz_dy")), 5).alias("ombra"))


@query(f"""WITH p AS ({_GRID}), s AS (SELECT c_custkey, c_custkey % 45 AS c, c_custkey % 61 AS r FROM customer) SELECT c_custkey, CASE WHEN v >= 1000 THEN v END AS v FROM s LEFT JOIN p ON p.r = s.r AND p.c = s.c""")
def sampled_points(spark: SparkSession, d: str) -> DataFrame:
    """Raster values at points, null outside and for nodata."""
    px = _pixels(spark, d).withColumn("v", F.when(F.col("v") >= 1000, F.col("v")).otherwise(-9999.0))
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select("c_custkey", ((k % 45) * 2 + 1).cast("double").alias("x"), (F.lit(500.0) - (k % 61) * 2 - 1).alias("y"))
    return raster.sample_points(points, px, 0.0, 500.0, 2.0).select("c_custkey", "v")


@query(f"""WITH p AS ({_GRID}), k AS (SELECT * FROM p WHERE (r + c) % 4 = 0), h AS (SELECT r, c FROM p WHERE (r + c) % 4 <> 0),
f AS (SELECT h.r, h.c, sum(k.v / (pow(h.r - k.r, 2) + pow(h.c - k.c, 2))) / sum(1 / (pow(h.r - k.r, 2) + pow(h.c - k.c, 2))) AS v FROM h JOIN k ON abs(h.r - k.r) <= 3 AND abs(h.c - k.c) <= 3 GROUP BY h.r, h.c)
SELECT r AS "row", c AS col, round_even(v, 6) AS v FROM (SELECT * FROM k UNION ALL SELECT * FROM f)""")
def filled_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Missing pixels filled from known ones near them."""
    px = _pixels(spark, d)
    return raster.fill_gaps(px.where((F.col("row") + F.col("col")) % 4 == 0), px.select("row", "col")).select("row", "col", F.bround("v", 6).alias("v"))


@query(f"""SELECT count(v) AS n, min(v) AS minimo, round_even(avg(v), 6) AS media, round_even(median(v), 6) AS mediana, round_even(quantile_cont(v, 0.9), 6) AS p90, max(v) AS massimo FROM ({_GRID})""")
def raster_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a whole raster in one row (A10)."""
    return raster.raster_stats(_pixels(spark, d)).select("n", "minimo", *[F.bround(c, 6).alias(c) for c in ("media", "mediana", "p90")], "massimo")


# --- Regions and geometry ---------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT s_suppkey AS region, CAST(s_suppkey * 13 % 97 AS DOUBLE) AS x0, CAST(s_suppkey * 29 % 89 AS DOUBLE) AS y0, 3.0 + s_suppkey % 5 AS w FROM supplier), p AS (SELECT c_custkey AS id, c_custkey * 0.37 % 100 + 0.0005 AS x, c_custkey * 0.71 % 90 + 0.0005 AS y FROM customer)
SELECT id, region FROM p JOIN r ON x > x0 AND x < x0 + w AND y > y0 AND y < y0 + w""")
def points_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """The regions that contain each point, by plane sweep (problem 4's regions, J8 X6)."""
    s = F.col("s_suppkey")
    x, y, w = (s * 13 % 97).cast("double"), (s * 29 % 89).cast("double"), (s % 5 + 3).cast("double")
    rings = table(spark, d, "supplier").select(s.alias("region"), F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + w), G.point(x, y + w)).alias("ring"))
    k = F.col("c_custkey").cast("double")
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (k * 0.37 % 100 + 0.0005).alias("x"), (k * 0.71 % 90 + 0.0005).alias("y"))
    return nearby.in_regions(points, rings, 10.0)


@query("""SELECT stop_id, round_even(stop_lat, 7) AS lat, round_even(stop_lon, 7) AS lon FROM (SELECT DISTINCT stop_id, stop_lat, stop_lon FROM fermate_gtfs) WHERE stop_lat BETWEEN 40 AND 50 AND stop_lon BETWEEN 6 AND 16""")
def projected_and_back(spark: SparkSession, d: str) -> DataFrame:
    """Degrees to metres of the zone and back, exact to the seventh digit."""
    s = table(spark, d, "fermate_gtfs").select("stop_id", "stop_lat", "stop_lon").distinct().where("stop_lat between 40 and 50 and stop_lon between 6 and 16")
    m = s.select("stop_id", G.to_metric(F.col("stop_lat"), F.col("stop_lon")).alias("m"))
    back = m.select("stop_id", G.to_degrees(F.col("m.x"), F.col("m.y")).alias("g"))
    return back.select("stop_id", F.bround("g.lat", 7).alias("lat"), F.bround("g.lon", 7).alias("lon"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 31 AS DOUBLE) AS x, CAST(p_partkey % 29 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS l FROM part)
SELECT p_partkey, y BETWEEN 10 AND 20 AND x <= 20 AND x + l >= 10 AS tocca, x AS x0, y AS y0, x + l AS x1, y AS y1 FROM p""")
def line_meets_region(spark: SparkSession, d: str) -> DataFrame:
    """Lines that touch a region, and their boxes."""
    p = F.col("p_partkey")
    x, y = (p % 31).cast("double"), (p % 29).cast("double")
    lines = table(spark, d, "part").select("p_partkey", F.array(G.point(x, y), G.point(x + F.col("p_size"), y)).alias("line"))
    ring = F.array(*[G.point(F.lit(a), F.lit(b)) for a, b in ((10, 10), (20, 10), (20, 20), (10, 20))])
    b = G.bounds(F.col("line"))
    return lines.select("p_partkey", G.line_meets(F.col("line"), ring).alias("tocca"), *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""SELECT s_suppkey, CAST(s_suppkey + 9 AS DOUBLE) AS x, 6.0 AS y, s_suppkey + 5.0 AS cx_fuori, true AS valido, false AS incrociato FROM supplier""")
def inner_points(spark: SparkSession, d: str) -> DataFrame:
    """A point inside a U-shaped ring, whose centre lies outside, and the test for rings that cross themselves."""
    s = F.col("s_suppkey")
    at = lambda *ps: F.array(*[G.point(s + x, F.lit(y)) for x, y in ps])
    u = at((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10))
    bow = at((0, 0), (10, 10), (10, 0), (0, 10))
    inner = G.inner_point(u)
    return table(spark, d, "supplier").select("s_suppkey", inner["x"].alias("x"), inner["y"].alias("y"), F.bround(G.centroid(u)["x"], 6).alias("cx_fuori"), G.is_simple_ring(u).alias("valido"), G.is_simple_ring(bow).alias("incrociato"))


@query("""SELECT c_nationkey, min(c_custkey) AS x0, max(c_custkey) AS x1 FROM customer GROUP BY c_nationkey""")
def hulls_of_groups(spark: SparkSession, d: str) -> DataFrame:
    """Convex hulls of points on two parallel lines: the ends of either (X11)."""
    c = table(spark, d, "customer").select("c_nationkey", F.explode(F.array(G.point(F.col("c_custkey"), F.lit(0)), G.point(F.col("c_custkey"), F.lit(1)))).alias("p")).select("c_nationkey", "p.x", "p.y")
    h = G.convex_hulls(c, "c_nationkey")
    xs = F.transform("hull", lambda p: p["x"])
    return h.select("c_nationkey", F.array_min(xs).cast("bigint").alias("x0"), F.array_max(xs).cast("bigint").alias("x1"))


@query("""SELECT s_suppkey, round_even(500 / 111320.0, 9) AS dlat, round_even(500 / (111320.0 * cos(radians(40 + s_nationkey * 0.5))), 9) AS dlon FROM supplier""")
def metres_in_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Spans of metres in degrees at a latitude (M8)."""
    dlat, dlon = X.metres_to_degrees(500.0, 40 + F.col("s_nationkey") * 0.5)
    return table(spark, d, "supplier").select("s_suppkey", F.bround(dlat, 9).alias("dlat"), F.bround(dlon, 9).alias("dlon"))


@query("""WITH k AS (SELECT 300.0 * 1.5 / 111320.0 AS a, 300.0 * sqrt(3) / (111320.0 * cos(radians(46.075))) AS b), g AS (SELECT unnest(generate_series(0, CAST(ceil(0.05 / a) AS INT))) AS r, a, b FROM k), h AS (SELECT r, unnest(generate_series(0, CAST(ceil(0.1 / b) AS INT) + 1)) AS c, a, b FROM g),
p AS (SELECT 46.05 + r * a AS lat, 11.1 + (c - CASE WHEN r % 2 = 1 THEN 0.5 ELSE 0 END) * b AS lon FROM h) SELECT round_even(lat, 7) AS lat, round_even(lon, 7) AS lon FROM p WHERE lat BETWEEN 46.06 AND 46.09 AND lon BETWEEN 11.12 AND 11.18""")
def covering_grid(spark: SparkSession, d: str) -> DataFrame:
    """Staggered circles that cover a box, those with their centre in a polygon (M9)."""
    ring = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((11.12, 46.06), (11.18, 46.06), (11.18, 46.09), (11.12, 46.09))])
    g = G.covering_grid(spark, 46.05, 46.10, 11.1, 11.2, 300.0).where(G.covers(ring, F.col("lon"), F.col("lat")))
    return g.select(F.bround("lat", 7).alias("lat"), F.bround("lon", 7).alias("lon"))


# --- Expressions and joins ----------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END AS plausibile, CASE WHEN c_custkey % 4 <> 0 THEN round_even(c_acctbal / (c_custkey % 4), 6) END AS quoziente, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS finito,
  CASE c_custkey % 5 WHEN 0 THEN 100.0 WHEN 1 THEN 0.0 WHEN 2 THEN 100.0 ELSE 50.0 END AS accessibile, round_even(c_acctbal / 2.5, 6) AS densita, CASE WHEN c_custkey % 40 < 5 THEN '<5' WHEN c_custkey % 40 < 10 THEN '5-10' WHEN c_custkey % 40 < 20 THEN '10-20' WHEN c_custkey % 40 < 30 THEN '20-30' ELSE '>30' END AS classe5,
  CASE WHEN c_custkey % 40 < 3 THEN 'pianeggiante' WHEN c_custkey % 40 < 8 THEN 'lieve' WHEN c_custkey % 40 < 15 THEN 'moderata' WHEN c_custkey % 40 < 25 THEN 'marcata' WHEN c_custkey % 40 < 35 THEN 'forte' ELSE 'molto forte' END AS classe6 FROM customer""")
def guarded_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Plausible values, safe quotients, finite numbers, truth scores, densities and slope classes."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    truth = F.element_at(F.array(F.lit(" TRUE"), F.lit("0"), F.lit("1"), F.lit("forse"), F.lit(None).cast("string")), (k % 5 + 1).cast("int"))
    slope = (k % 40).cast("double")
    return table(spark, d, "customer").select(
        "c_custkey",
        X.plausible(b, 0, 5000).alias("plausibile"),
        F.bround(X.safe_divide(b, (k % 4).cast("double")), 6).alias("quoziente"),
        X.finite(F.when(k % 3 == 0, F.when(k % 2 == 0, float("inf")).otherwise(float("nan"))).otherwise(b)).alias("finito"),
        X.truth_score(truth).alias("accessibile"),
        F.bround(X.safe_divide(b, F.lit(2.5)), 6).alias("densita"),
        X.bins(slope, X.SLOPE_EDGES, X.SLOPE_LABELS, right_closed=False).alias("classe5"),
        X.bins(slope, X.SLOPE6_EDGES, X.SLOPE6_LABELS, right_closed=False).alias("classe6"),
    )


@query("""WITH c AS (SELECT scheda_id, min(nome) AS nome, min(servizio) AS servizio, min(attore) AS attore, min(mapcategory) AS cat, min(accesso) AS accesso FROM cultura_socialita_e_spazi_comuni GROUP BY scheda_id)
SELECT scheda_id, coalesce(nullif(trim(accesso, ' '), ''), nullif(trim(servizio, ' '), '')) AS primo, coalesce(nullif(trim(cat, ' '), ''), 'non_classificato') AS categoria, coalesce(nullif(trim(regexp_extract('Seduta di ' || servizio, ' di (.+)$', 1), ' '), ''), NULL) AS data,
  concat_ws(' ', nullif(trim(servizio, ' '), ''), nullif(trim(cat, ' '), '')) AS unito, substr(regexp_replace(regexp_replace(lower(strip_accents(cat)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 140) AS slug, trim(regexp_replace('  a ' || servizio || ' ', '\\s+', ' ', 'g'), ' ') AS pulito FROM c""")
def first_texts(spark: SparkSession, d: str) -> DataFrame:
    """First text that isn't blank, defaults, dates in titles, joined parts, slugs and squeezed blanks."""
    c = table(spark, d, "cultura_socialita_e_spazi_comuni").groupBy("scheda_id").agg(*[F.min(n).alias(n) for n in ("servizio", "mapcategory", "accesso")])
    s, m = F.col("servizio"), F.col("mapcategory")
    return c.select(
        "scheda_id",
        X.first_text(F.col("accesso"), s).alias("primo"),
        X.first_text(m, F.lit("non_classificato")).alias("categoria"),
        X.date_in_title(F.concat(F.lit("Seduta di "), s)).alias("data"),
        F.concat_ws(" ", X.first_text(s), X.first_text(m)).alias("unito"),
        X.slug(m).alias("slug"),
        X.squeeze(F.concat(F.lit("  a "), s, F.lit(" "))).alias("pulito"),
    )


@query("""SELECT n_nationkey, n_name AS naz_n_name, n_regionkey AS naz_n_regionkey, s.n AS ser_n, s.saldo AS ser_saldo FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n, round_even(sum(s_acctbal), 2) AS saldo FROM supplier GROUP BY s_nationkey) s ON s_nationkey = n_nationkey""")
def unique_join(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one join of tables whose columns got prefixes."""
    n = joins.prefixed(table(spark, d, "nation"), "naz_", "n_nationkey")
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.bround(F.sum("s_acctbal"), 2).alias("saldo"))
    return joins.join_unique(n, joins.prefixed(s, "ser_", "n_nationkey"), "n_nationkey")


@query("""SELECT o_custkey, n > 3 AS has_populartimes, prima AS time_spent, o_custkey AS cliente FROM (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS prima FROM orders GROUP BY o_custkey)""")
def poi_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether a list holds anything, its first element, and aliases of columns."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("times"))
    flagged = o.select("o_custkey", X.has_items(F.slice("times", 4, 100)).alias("has_populartimes"), F.get("times", F.lit(0)).alias("time_spent"))
    return X.add_missing(flagged, {"cliente": "o_custkey", "time_spent": "o_custkey", "assente": "niente"})


@query("""SELECT sez21_id, least(tempo_associazioni_min, tempo_cultura_min, tempo_ristorazione_min, tempo_attivita_economiche_min, tempo_fermata_min) AS minimo, CAST(coalesce(servizi_5_min, 0) + coalesce(servizi_15_min, 0) AS DOUBLE) AS somma
FROM (SELECT DISTINCT sez21_id, tempo_associazioni_min, tempo_cultura_min, tempo_ristorazione_min, tempo_attivita_economiche_min, tempo_fermata_min, servizi_5_min, servizi_15_min FROM assegnazione_cluster_sezioni)""")
def row_minima_and_sums(spark: SparkSession, d: str) -> DataFrame:
    """Least and sum over columns chosen by a pattern of their names."""
    a = table(spark, d, "assegnazione_cluster_sezioni")
    times, counts = joins.matching_columns(a.columns, r"^tempo_.*_min$"), joins.matching_columns(a.columns, r"^servizi_\d+_min$")
    s = a.select("sez21_id", *times, *counts).distinct()
    return s.select("sez21_id", X.least_of(*[F.col(c) for c in times]).alias("minimo"), X.sum_of(*[F.col(c) for c in counts]).alias("somma"))


@query("""WITH m AS (SELECT median(v) AS m FROM (SELECT CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS v FROM supplier)) SELECT s_suppkey, round_even(CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal ELSE m END, 6) AS quota FROM supplier, m""")
def imputed_heights(spark: SparkSession, d: str) -> DataFrame:
    """Missing heights as the median of the known ones (M6)."""
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("quota"))
    return ranking.impute_median(s, ["quota"]).withColumn("quota", F.bround("quota", 6))


@query("""SELECT CAST(count(*) FILTER (c_acctbal <= 2500) AS BIGINT) AS bassa, CAST(count(*) FILTER (c_acctbal > 2500 AND c_acctbal <= 5000) AS BIGINT) AS media, CAST(count(*) FILTER (c_acctbal > 5000) AS BIGINT) AS alta FROM customer""")
def counts_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Counts of classes in one row."""
    c = table(spark, d, "customer").select(X.bins(F.col("c_acctbal"), (2500, 5000), ("bassa", "media", "alta")).alias("classe"))
    return c.agg(*[F.count_if(F.col("classe") == n).alias(n) for n in ("bassa", "media", "alta")])


@query("""SELECT nome, via, lat, lon, min(o) AS ord FROM (SELECT lower(p_brand) AS nome, p_type AS via, p_size % 5 AS lat, p_size % 3 AS lon, p_partkey AS o FROM part) GROUP BY nome, via, lat, lon""")
def deduplicated_pois(spark: SparkSession, d: str) -> DataFrame:
    """The first of the rows with one name, address and place."""
    p = table(spark, d, "part").select(F.lower("p_brand").alias("nome"), F.col("p_type").alias("via"), (F.col("p_size") % 5).alias("lat"), (F.col("p_size") % 3).alias("lon"), F.col("p_partkey").alias("ord"))
    return ranking.deduplicate(p, ["nome", "via", "lat", "lon"], "ord")


@query("""SELECT p_partkey, p_size * 3 AS metri, CASE WHEN p_size * 3 <= 40 AND p_retailprice / 2000 >= 0.72 THEN 'corrispondenza_probabile' WHEN p_size * 3 <= 100 AND p_retailprice / 2000 >= 0.55 THEN 'da_verificare_possibile_match' ELSE 'nuovo_candidato' END AS stato FROM part""")
def external_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of an external match by score and distance."""
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 3).alias("metri"), matching.external_status(F.col("p_retailprice") / 2000, F.col("p_size") * 3).alias("stato"))
