"""Queries of the general data-processing operators (packed fields, points near points) and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import degrees_of, position_of, usual_region
from ..operators.nearby import within_distance
from ..operators.packed_lists import explode_packed
from ..runtime import table

PACKED_FIELDS = ("stop_ids", "feed_sources", "linee_urbane", "linee_extraurbane")
NEAR_M = 250.0


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops within 250 m of each record of the places table."""
    records, stops = table(spark, sf_dir, "cultura_socialita_e_spazi_comuni"), table(spark, sf_dir, "fermate_gtfs")
    region = usual_region(stops, F.col("stop_lat"), F.col("stop_lon"))
    at = lambda lat, lon: position_of(lat, lon, region).alias("p")
    left = records.select(F.col("scheda_id").alias("id"), at(degrees_of(F.col("latitudine")), degrees_of(F.col("longitudine"))))
    right = stops.select(F.col("stop_id").alias("id"), at(F.col("stop_lat"), F.col("stop_lon")))
    near = within_distance(left.select("id", "p.lat", "p.lon"), right.select("id", "p.lat", "p.lon"), NEAR_M)
    return near.select(F.col("left_id").alias("scheda_id"), F.col("right_id").alias("stop_id")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the four packed fields with its position."""
    return explode_packed(table(spark, sf_dir, "fermate_gtfs_aggregate"), "stop_cluster_id", PACKED_FIELDS, "caricato_il")


def _degrees_sql(c: str) -> str:
    t = f"upper(trim({c}))"
    dms = r"'(\d{1,3})\s*°\s*(\d{1,2})\s*''\s*(\d{1,2}([.,]\d+)?)?'"
    part = lambda i: f"try_cast(replace(regexp_extract({t}, {dms}, {i}), ',', '.') AS DOUBLE)"
    number = rf"regexp_extract({t}, '^(?:LAT|LON|LONG|LNG|[NSEWO])?[.:]?\s*[+-]?\s*(\d+(?:[.,]\d+)?)\s*°?\s*[NSEWO]?$', 1)"
    sign = rf"CASE WHEN regexp_matches({t}, '(^|[^A-Z])[SWO]([^A-Z]|$)') OR regexp_matches({t}, '^\D*-\s*\d') THEN -1 ELSE 1 END"
    return f"({sign}) * CASE WHEN regexp_matches({t}, {dms}) THEN {part(1)} + {part(2)} / 60 + coalesce({part(3)}, 0) / 3600 ELSE try_cast(replace({number}, ',', '.') AS DOUBLE) END"


def _position_sql(source: str) -> str:
    """Rows (id, lat, lon) of ``source`` (id, a, o) read as they evidently mean; ``region`` is a one-row table in scope."""
    pointed = lambda v, lo, hi: "coalesce(" + ", ".join(f"CASE WHEN {v} / 1e{k} BETWEEN {lo} AND {hi} THEN {v} / 1e{k} END" for k in range(1, 13)) + ")"
    pa, po = pointed("a", "s", "n"), pointed("o", "w", "e")
    sa, so = pointed("o", "s", "n"), pointed("a", "w", "e")
    whole = "(abs(a) > 90 OR abs(o) > 180)"
    cases = lambda own, swap, lost, both, plain: (
        f"CASE WHEN a BETWEEN s AND n AND o BETWEEN w AND e THEN {own} WHEN o BETWEEN s AND n AND a BETWEEN w AND e THEN {swap} "
        f"WHEN {whole} AND {pa} IS NOT NULL AND {po} IS NOT NULL THEN {lost} WHEN {whole} AND {sa} IS NOT NULL AND {so} IS NOT NULL THEN {both} "
        f"WHEN a BETWEEN -90 AND 90 AND o BETWEEN -180 AND 180 AND NOT (a = 0 AND o = 0) THEN {plain} END"
    )
    return f"SELECT id, {cases('a', 'o', pa, sa, 'a')} AS lat, {cases('o', 'a', po, so, 'o')} AS lon FROM (SELECT DISTINCT id, a, o FROM ({source}) WHERE NOT isnan(a) AND NOT isnan(o)), region"


P4_SQL = f"""
WITH usable AS (SELECT stop_lat AS a, stop_lon AS o FROM fermate_gtfs WHERE stop_lat BETWEEN -90 AND 90 AND stop_lon BETWEEN -180 AND 180 AND NOT (stop_lat = 0 AND stop_lon = 0)),
quart AS (SELECT quantile_disc(a, 0.25) AS a1, quantile_disc(a, 0.75) AS a3, quantile_disc(o, 0.25) AS o1, quantile_disc(o, 0.75) AS o3 FROM usable),
region AS (SELECT a1 - 3 * (a3 - a1) - 1 AS s, a3 + 3 * (a3 - a1) + 1 AS n, o1 - 3 * (o3 - o1) - 1 AS w, o3 + 3 * (o3 - o1) + 1 AS e FROM quart),
l AS ({_position_sql(f"SELECT scheda_id AS id, {_degrees_sql('latitudine')} AS a, {_degrees_sql('longitudine')} AS o FROM cultura_socialita_e_spazi_comuni")}),
r AS ({_position_sql("SELECT stop_id AS id, stop_lat AS a, stop_lon AS o FROM fermate_gtfs")})
SELECT DISTINCT l.id AS scheda_id, r.id AS stop_id FROM l JOIN r ON r.lat BETWEEN l.lat - 0.01 AND l.lat + 0.01
WHERE 2 * 6371000.0 * asin(sqrt(pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2))) <= {NEAR_M}
"""

P6_SQL = r"""
WITH raw AS (
  SELECT stop_cluster_id, campo, any_value(v) AS v FROM (
    SELECT stop_cluster_id, 'stop_ids' AS campo, stop_ids AS v FROM fermate_gtfs_aggregate UNION ALL
    SELECT stop_cluster_id, 'feed_sources', feed_sources FROM fermate_gtfs_aggregate UNION ALL
    SELECT stop_cluster_id, 'linee_urbane', linee_urbane FROM fermate_gtfs_aggregate UNION ALL
    SELECT stop_cluster_id, 'linee_extraurbane', linee_extraurbane FROM fermate_gtfs_aggregate)
  WHERE v IS NOT NULL GROUP BY ALL),
bare AS (SELECT stop_cluster_id, campo, regexp_replace(BLANKLESS(v), '^\[(.*)\]$|^\{(.*)\}$', '\1\2') AS v FROM raw),
tokens AS (SELECT stop_cluster_id, campo, regexp_extract_all(v, '\s*"(?:[^"\\]|\\.|"")*"\s*|\s*''(?:[^'']|'''')*''\s*|(?:[^,;|\t\n" ]| +[^,;|\t\n"'' ])+') AS ts FROM bare),
parts AS (SELECT stop_cluster_id, campo, flatten(list_transform(ts, lambda t:
    CASE WHEN regexp_matches(BLANKLESS(t), '^".*"$') OR regexp_matches(BLANKLESS(t), '^''.*''$') THEN [BLANKLESS(t)]
         WHEN regexp_matches(BLANKLESS(t), '^\d+( +\d+)+$') THEN regexp_split_to_array(BLANKLESS(t), ' +')
         ELSE regexp_split_to_array(regexp_replace(' ' || t || ' ', '\s(e|[/+-])\s', chr(1), 'g'), chr(1)) END)) AS ps FROM tokens),
vals AS (SELECT stop_cluster_id, campo, list_filter(list_transform(ps, lambda p:
    CASE WHEN regexp_matches(BLANKLESS(p), '^".*"$') THEN trim(regexp_replace(replace(substr(BLANKLESS(p), 2, length(BLANKLESS(p)) - 2), '""', '"'), '\\(.)', '\1', 'g'))
         WHEN regexp_matches(BLANKLESS(p), '^''.*''$') THEN trim(replace(substr(BLANKLESS(p), 2, length(BLANKLESS(p)) - 2), '''''', '''')) ELSE BLANKLESS(p) END), lambda x: x <> '') AS vs FROM parts)
SELECT stop_cluster_id, campo, CAST(generate_subscripts(vs, 1) AS INTEGER) AS posizione, unnest(vs) AS valore
FROM vals WHERE NOT (len(vs) = 1 AND lower(vs[1]) IN ('-', '--', 'n.d.', 'n.d', 'nd', 'n/d', 'n/a', 'na', 'null', 'none', 'nan', 'nessuno', 'nessuna', 'nessun valore', 'vuoto', 'assente'))
"""
P6_SQL = re.sub(r"BLANKLESS\((\w)\)", r"trim(\1, chr(32) || chr(9) || chr(10))", P6_SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p6_found": p6_found}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p6_found": P6_SQL}
