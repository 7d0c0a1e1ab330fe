"""Queries that write with a writer and read back with a reader: what comes back is what went in."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import facets, graph, matching, ranking
from ..runtime import shared_folder, table
from ..sources import geotiff, readers, writers
from .core_queries import query


def _folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one, removed when the session ends."""
    path = f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def layer_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A layer written by zone, replaced whole, and read again (K1)."""
    path = _folder(spark)
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    writers.write_layer(c.where("c_custkey < 0"), path, ["c_nationkey"])
    writers.write_layer(c, path, ["c_nationkey"])
    return spark.read.schema(c.schema).parquet(path).select(*c.columns)


@query("""SELECT c_custkey, 'Point' AS tipo, CAST(c_nationkey AS DOUBLE) AS x, c_custkey % 80 + 0.5 AS y, replace(c_name, '#', '"') AS nome FROM customer""")
def geojson_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Features in degrees written one a line and read again."""
    path = _folder(spark)
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), (F.col("c_custkey") % 80 + 0.5).cast("double").alias("y"), F.replace("c_name", F.lit("#"), F.lit('"')).alias("nome"))
    readers.check_degrees(c)
    writers.write_geojson_lines(c, path, "Point", F.array("x", "y"), ["c_custkey", "nome"])
    at = F.from_json("coordinates", "array<double>")
    return readers.geojson_lines(spark, path).select(F.col("properties")["c_custkey"].cast("bigint").alias("c_custkey"), F.col("geometry_type").alias("tipo"), at[0].alias("x"), at[1].alias("y"), F.col("properties")["nome"].alias("nome"))


@query("""SELECT n_regionkey, CAST(ord AS INTEGER) AS ord, n_name AS nome, CAST(n_nationkey * 2 AS VARCHAR) AS quota, CASE WHEN ord % 2 = 0 THEN 'pari' END AS nuovo FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord FROM nation)""")
def geojson_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Feature collections read whole, and properties added by position."""
    path = _folder(spark)
    n = table(spark, d, "nation")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))]))).alias("coordinates")).alias("geometry"), F.struct(F.col("n_name").alias("nome"), F.lit("x").alias("quota"), F.col("n_regionkey")).alias("properties"))
    collections = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", feature.alias("f")))).alias("fs"))
    _write_each(collections, path)
    features = readers.geojson_features(spark, f"{path}/*/*.txt").where(F.size(readers.rings_of(F.col("geometry_type"), F.col("coordinates"))) == 1)
    region = F.col("properties")["n_regionkey"]
    # Positions count within each collection; the region tells collections apart here.
    keyed = features.withColumn("ord", F.concat_ws("/", region, "ord"))
    place = F.row_number().over(ranking.Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    more = n.select(F.concat_ws("/", "n_regionkey", place).alias("ord"), (F.col("n_nationkey") * 2).alias("quota"), F.when(place % 2 == 0, "pari").alias("nuovo"))
    p = F.col("properties")
    return readers.enriched_features(keyed, more).select(p["n_regionkey"].cast("int").alias("n_regionkey"), F.split("ord", "/")[1].cast("int").alias("ord"), p["nome"].alias("nome"), p["quota"].alias("quota"), p["nuovo"].alias("nuovo"))


def _write_each(collections: DataFrame, path: str) -> None:
    """One file for each collection."""
    whole = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda f: f["f"]).alias("features")))
    collections.select("n_regionkey", whole.alias("value")).write.partitionBy("n_regionkey").text(path)


@query("""SELECT s_suppkey, s_name || '; "A"' AS s_name, s_acctbal FROM supplier""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table without its geometry as CSV, read again by its sniffed delimiter (K4 S3)."""
    path = _folder(spark)
    s = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit('; "A"')).alias("s_name"), "s_acctbal", F.array(G.point(F.lit(0), F.lit(0))).alias("geom"))
    writers.write_table(s, path)
    back = readers.sniffed_csv(spark, path)
    return back.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("""SELECT 'clienti' AS indicatore, CAST(count(*) AS DOUBLE) AS valore FROM customer UNION ALL SELECT 'saldo_massimo', max(c_acctbal) FROM customer""")
def summary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A summary of one row written as key and value and read again (K5 K6)."""
    path = _folder(spark)
    writers.write_table(facets.unpivot_summary(table(spark, d, "customer").agg(F.count("*").alias("clienti"), F.max("c_acctbal").alias("saldo_massimo"))), path)
    return spark.read.option("header", True).option("escape", '"').schema("indicatore string, valore double").csv(path)


@query("""SELECT 'pesi' AS chiave, '{"a":0.4,"b":0.6}' AS valore UNION ALL SELECT 'righe', CAST(count(*) AS VARCHAR) FROM nation""")
def metadata_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Facts about a run as one JSON file (K7)."""
    path = _folder(spark)
    writers.write_metadata(spark, path, {"pesi": {"a": 0.4, "b": 0.6}, "righe": table(spark, d, "nation").count()})
    text = spark.read.text(path)
    return text.select(F.explode(F.array(*[F.struct(F.lit(k).alias("chiave"), F.get_json_object("value", f"$.{k}").alias("valore")) for k in ("pesi", "righe")])).alias("r")).select("r.*")


@query("""WITH b AS (SELECT service_row, max(score) AS score FROM servizi_povo_candidati_match WHERE score IS NOT NULL GROUP BY service_row) SELECT service_row, score FROM b WHERE score < 94""")
def review_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Services that weren't matched for sure, written for review and read again."""
    path = _folder(spark)
    best = table(spark, d, "servizi_povo_candidati_match").where("score is not null").groupBy("service_row").agg(F.max("score").alias("score"))
    # Only the sure score counts here: no gap is wide enough for less.
    open_ = best.where(matching.match_status(F.col("score"), F.lit(0.0)) != "automatico")
    writers.write_table(open_, path)
    return spark.read.option("header", True).schema("service_row bigint, score double").csv(path)


@query("""SELECT o_custkey % 5 AS feed, o_orderkey AS trip_id, '' AS assente, printf('%02d:%02d:00', o_orderkey % 30, o_orderkey % 60) AS departure_time FROM orders""")
def gtfs_archives(spark: SparkSession, d: str) -> DataFrame:
    """Members of timetable archives, all text, missing columns empty."""

    def archive(g: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("gtfs/stop_times.txt", "﻿" + g[["trip_id", "departure_time"]].to_csv(index=False))
        return pd.DataFrame({"path": [str(g["feed"].iloc[0])], "content": [out.getvalue()]})

    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("feed"), k.alias("trip_id"), F.format_string("%02d:%02d:00", k % 30, k % 60).alias("departure_time"))
    files = o.groupBy("feed").applyInPandas(archive, "path string, content binary")
    rows = readers.gtfs_rows(files, "stop_times.txt", ["trip_id", "assente", "departure_time"])
    return rows.select(F.col("feed").cast("bigint").alias("feed"), F.col("trip_id").cast("bigint").alias("trip_id"), "assente", "departure_time")


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_discount / 1.2 END AS secondi, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL""")
def graphml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Networks as GraphML documents, read again with missing times estimated."""
    li = table(spark, d, "lineitem").where("l_linenumber <= 2")
    even = F.col("l_linenumber") % 2 == 0
    edges = li.select((F.col("l_suppkey") % 8).alias("zona"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), F.lit(None).cast("double").alias("travel_time"), F.when(even, F.col("l_quantity")).alias("walk_time_s"), F.when(~even, F.col("l_discount")).alias("length"))
    _, back = readers.graphml_parts(writers.graphml_documents(edges, "zona"))
    return graph.repaired_weights(back).groupBy("src", "dst", F.col("walk_time_s").alias("secondi")).agg(F.count("*").alias("n"))


@query("""SELECT n_regionkey AS foglio, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS riga, CAST(n_nationkey AS VARCHAR) AS codice, n_name AS nome FROM nation""")
def excel_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Rows of workbooks with numbers and shared texts."""

    def workbook(g: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        g, ns = g.sort_values("n_nationkey"), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{k}</v></c><c r="B{i}" t="s"><v>{i - 1}</v></c><c r="C{i}" t="inlineStr"><is><t>{r}</t></is></c></row>' for i, (k, r) in enumerate(zip(g["n_nationkey"], g["n_regionkey"], strict=True), 1))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{n}</t></si>" for n in g["n_name"]) + "</sst>")
        return pd.DataFrame({"content": [out.getvalue()]})

    files = table(spark, d, "nation").groupBy("n_regionkey").applyInPandas(workbook, "content binary")
    c = F.col("cells")
    return readers.excel_rows(files).select(c["C"].cast("int").alias("foglio"), F.col("row").alias("riga"), c["A"].alias("codice"), c["B"].alias("nome"))


@query("""WITH p AS (SELECT p_partkey // 300 AS r, p_partkey % 300 AS c, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS v FROM part),
o AS (SELECT 0 AS level, r, c, v, 2.0 AS size FROM p UNION ALL SELECT 1, r // 2, c // 2, avg(v), 4.0 FROM p GROUP BY 2, 3) SELECT level, (c + 0.5) * size + 1000 AS x, 9000 - (r + 0.5) * size AS y, round_even(v, 2) AS v FROM o""")
def geotiff_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A pixel table as deflated tiles with averaged overviews, read again by map coordinates."""
    px = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 300).alias("row"), (F.col("p_partkey") % 300).alias("col"), F.col("p_retailprice").alias("v"))
    back = geotiff.raster_pixels(geotiff.raster_tiles(px, 1000.0, 9000.0, 2.0), 25832)
    return back.where("level <= 1").select("level", "x", "y", F.bround("v", 2).alias("v"))


@query("""SELECT p_partkey, 'P' || p_partkey AS nome, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 80 + 0.5 END AS lat, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 170 + 0.25 END AS lon FROM part""")
def place_features(spark: SparkSession, d: str) -> DataFrame:
    """Place features: primary or plain name, positions of points only."""
    k = F.col("p_partkey")
    key = k.cast("string")
    names = F.when(k % 3 == 0, F.concat(F.lit('"names":{"primary":"P'), key, F.lit('"}'))).otherwise(F.concat(F.lit('"name":"P'), key, F.lit('"')))
    geometry = F.when(k % 2 == 0, F.concat(F.lit('{"type":"Point","coordinates":['), (k % 170 + 0.25).cast("string"), F.lit(","), (k % 80 + 0.5).cast("string"), F.lit("]}"))).otherwise('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}')
    raw = table(spark, d, "part").select(F.concat(F.lit('{"features":[{"geometry":'), geometry, F.lit(',"properties":{'), names, F.lit("}}]}")).alias("value"))
    return readers.overture_features(raw).select(F.substring("name", 2, 20).cast("bigint").alias("p_partkey"), F.col("name").alias("nome"), "lat", "lon")


@query("""SELECT p_partkey, p_partkey % 80 + 0.5 AS lat, p_partkey % 170 + 0.25 AS lon FROM part""")
def poi_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions from number columns, well-known text or GeoJSON."""
    k = F.col("p_partkey")
    lat, lon = (k % 80 + 0.5).cast("string"), (k % 170 + 0.25).cast("string")
    none = F.lit(None).cast("string")
    at = readers.poi_position(F.when(k % 3 == 0, lat).otherwise("n.d."), F.when(k % 3 == 0, lon), F.when(k % 3 == 1, F.concat(F.lit("POINT ("), lon, F.lit(" "), lat, F.lit(")"))).otherwise(none), F.when(k % 3 == 2, F.concat(F.lit('{"type":"Point","coordinates":['), lon, F.lit(","), lat, F.lit("]}"))).otherwise(none))
    return table(spark, d, "part").select("p_partkey", at["lat"].alias("lat"), at["lon"].alias("lon"))


@query("""SELECT '2026' AS periodo, CAST(s_nationkey AS VARCHAR) AS sala_id, 'Sala ' || s_nationkey AS sala, s_name AS evento FROM supplier""")
def room_bookings(spark: SparkSession, d: str) -> DataFrame:
    """Room calendars, one row an entry."""
    rooms = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list("s_name").alias("dati"))
    key = F.col("s_nationkey").cast("string")
    raw = rooms.select(F.to_json(F.struct(F.lit("2026").alias("periodo"), F.create_map(key, F.struct(key.alias("id"), F.concat(F.lit("Sala "), key).alias("nome"), "dati")).alias("sale"))).alias("value"))
    return readers.bookings(raw)


@query("""SELECT c_custkey, c_custkey + 0.5 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer WHERE c_custkey % 5 = 0 AND c_nationkey IS NOT NULL""")
def valid_points(spark: SparkSession, d: str) -> DataFrame:
    """Features that are points with a position: none that is missing, empty or of another kind."""
    k = F.col("c_custkey")
    kind = F.when(k % 5 <= 1, "Point").when(k % 5 == 2, "Polygon").when(k % 5 == 3, "MultiPoint")
    at = F.when(k % 5 == 0, F.concat(F.lit("["), (k + 0.5).cast("string"), F.lit(","), F.col("c_nationkey").cast("string"), F.lit("]"))).when(k % 5 == 1, "[]").when(k % 5 == 2, "[[[0,0],[1,0],[1,1]]]").when(k % 5 == 3, "[[1,2]]")
    features = table(spark, d, "customer").select("c_custkey", kind.alias("geometry_type"), at.alias("coordinates"))
    return readers.valid_points(features).select("c_custkey", "x", "y")
