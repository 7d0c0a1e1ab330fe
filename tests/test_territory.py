import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentiero.functions import expressions as X
from sentiero.functions import geometry as G
from sentiero.operators import facets, graph, joins, matching, ranking, raster, transit
from sentiero.sources import geotiff, readers, writers


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=500).round(2), rng.integers(0, 4, 500).astype(float)
    rows = [(float(x), float(y), None) for x, y in zip(a, b, strict=True)] + [(None, float("nan"), None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = ranking.exact_quantiles(df, ["a", "b", "c"], (0.0, 0.01, 0.5, 0.77, 1.0)).first()
    assert np.allclose(got["a"], np.quantile(a, [0, 0.01, 0.5, 0.77, 1])) and np.allclose(got["b"], np.quantile(b, [0, 0.01, 0.5, 0.77, 1]))
    assert got["c"] == [None] * 5
    one = ranking.exact_quantiles(spark.createDataFrame([(3.0,)], "a double"), ["a"], (0.25,)).first()["a"]
    assert one == [3.0] and ranking.exact_quantiles(df.limit(0), ["a"], (0.5,)).first()["a"] == [None]


def test_surrogate_ids(spark):
    keys = [5, -3, 100, 7, 2**40]
    got = {r["k"]: r["n"] for r in ranking.surrogate_ids(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k", "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), 1)}
    coded = ranking.surrogate_ids(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k", "n", "P-", 4).collect()
    assert {r["n"] for r in coded} == {f"P-{i:04d}" for i in range(1, 6)}


def test_gaps_are_filled_from_the_nearest_ring(spark):
    schema = "row int, col int, v double"
    known = spark.createDataFrame([(0, 0, 2.0), (0, 60, 6.0), (5, 5, None)], schema)
    places = spark.createDataFrame([(0, 0), (0, 1), (0, 30), (0, 59), (0, 500)], "row int, col int")
    got = {(r["row"], r["col"]): r["v"] for r in raster.fill_gaps(known, places).collect()}
    assert got[0, 0] == 2.0 and got[0, 1] == 2.0 and got[0, 59] == 6.0 and got[0, 500] is None
    assert got[0, 30] == pytest.approx(4.0)
    assert raster.fill_gaps(known.limit(0), places).where("v is null").count() == 5


def test_routes(spark):
    routes = spark.createDataFrame([("a", "5.0"), ("b", " 5/ "), ("c", None)], "route_id string, route_short_name string")
    assert [r["route_id"] for r in transit.chosen_routes(routes, ["5"]).collect()] == ["a"]
    with pytest.raises(ValueError, match="there are"):
        transit.chosen_routes(routes, ["99"])
    lines = spark.createDataFrame([(1, True, None), (2, None, None), (3, False, True)], "id int, crosses boolean, inner_stop boolean")
    assert {r["id"] for r in transit.relevant_lines(lines).collect()} == {1, 3}
    trips = spark.createDataFrame([("t", "r", "s"), ("u", "r", "s"), ("v", "r", None)], "trip_id string, route_id string, shape_id string")
    shapes = spark.createDataFrame([("s", 10, 1.0, 1.0), ("s", 9, 0.0, 0.0), ("z", 1, 0.0, 0.0)], "shape_id string, shape_pt_sequence int, x double, y double")
    found = transit.route_shapes(trips, shapes).collect()
    assert len(found) == 1 and [tuple(p) for p in found[0]["line"]] == [(0.0, 0.0), (1.0, 1.0)]


def test_dissolved_lines(spark):
    at = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    rows = [("a", at((0, 0), (3, 0), (3, 4))), ("a", at((3, 4), (3, 0))), ("a", at((9, 9))), ("b", at((0, 0), (0, 5)))]
    got = {r["k"]: (len(r["segmenti"]), r["metri"]) for r in transit.dissolve_lines(spark.createDataFrame(rows, "k string, line array<struct<x:double,y:double>>"), ["k"]).collect()}
    assert got == {"a": (2, 7.0), "b": (1, 5.0)}


def test_small_rules(spark):
    one = spark.range(1)
    status = one.select(matching.external_status(F.lit(0.8), F.lit(30.0)).alias("a"), matching.external_status(F.lit(0.6), F.lit(90.0)).alias("b"), matching.external_status(F.lit(0.9), F.lit(200.0)).alias("c"), matching.external_status(F.lit(None).cast("double"), F.lit(1.0)).alias("d")).first()
    assert tuple(status) == ("corrispondenza_probabile", "da_verificare_possibile_match", "nuovo_candidato", "nuovo_candidato")
    row = one.select(X.least_of(F.lit(None).cast("int"), F.lit(4), F.lit(2)).alias("a"), X.sum_of(F.lit(None).cast("int"), F.lit(4)).alias("b"), X.least_of(F.lit(7)).alias("c"), graph.slope_penalty(F.lit(3.0), F.lit(2.0)).alias("d"), graph.slope_penalty(F.lit(3.0), F.lit(0.0)).alias("e")).first()
    assert tuple(row) == (2, 4.0, 7, 50.0, None)
    assert joins.matching_columns(["tempo_a_min", "tempo_b", "x"], r"^tempo_.*_min$") == ["tempo_a_min"]
    labels = [r["v"] for r in facets.collated_counts(spark.createDataFrame([("zeta",), ("èra",), ("Eco",), ("zeta",), (None,)], "v string"), "v").collect()]
    assert labels == ["zeta", "Eco", "èra"]


def test_inner_point(spark):
    ring = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10))])
    flat = F.array(*[G.point(F.lit(x), F.lit(1)) for x in (0, 1, 2)])
    r = spark.range(1).select(G.inner_point(ring).alias("p"), G.covers(ring, G.inner_point(ring)["x"], G.inner_point(ring)["y"]).alias("inside"), G.inner_point(flat).alias("none")).first()
    assert r["inside"] and r["none"] is None


def test_raster_files():
    a = np.arange(300 * 270, dtype="f4").reshape(300, 270)
    a[5, 7] = -9999
    images = list(geotiff.decode(geotiff.encode(a, 100.0, 900.0, 2.0)))
    assert (images[0]["array"] == a).all() and len(images) == 5 and images[1]["array"].shape == (150, 135)
    assert images[1]["array"][0, 0] == a[:2, :2].mean() and images[1]["size"] == 4.0
    assert (images[0]["x0"], images[0]["y0"], images[0]["size"], images[0]["nodata"], images[0]["epsg"]) == (100.0, 900.0, 2.0, -9999.0, 25832)
    with pytest.raises(ValueError):
        next(geotiff.decode(b"PK\3\4"))
    # strips, big-endian 16-bit integers, without map tags
    strips = [zlib.compress(np.arange(i, i + 8, dtype=">i2").tobytes()) for i in (0, 8)]
    out = bytearray(b"MM\0*" + struct.pack(">I", 8 + sum(map(len, strips)) + 16)) + b"".join(strips)
    places, sizes = [8, 8 + len(strips[0])], [len(s) for s in strips]
    at = len(out)
    out += struct.pack(">4I", *places, *sizes)
    entries = [(256, 4, 1, 4), (257, 4, 1, 4), (258, 3, 1, 16 << 16), (259, 3, 1, 8 << 16), (273, 4, 2, at), (277, 3, 1, 1 << 16), (278, 4, 1, 2), (279, 4, 2, at + 8), (339, 3, 1, 2 << 16)]
    out += struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + b"\0\0\0\0"
    image = next(geotiff.decode(bytes(out)))
    assert (image["array"] == np.arange(16).reshape(4, 4)).all() and image["nodata"] is None


def test_raster_checks_its_map(spark):
    px = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (300, 2, 3.0)], "row int, col int, v double")
    files = geotiff.raster_tiles(px, 0.0, 1000.0, 1.0)
    assert files.count() == 2
    got = sorted((r["x"], r["y"], r["v"]) for r in geotiff.raster_pixels(files, 25832).where("level = 0").collect())
    assert got == [(0.5, 999.5, 1.0), (2.5, 699.5, 3.0)]
    assert geotiff.raster_pixels(files, None, (2.0, 0.0, 3.0, 800.0)).where("level = 0").count() == 1
    with pytest.raises(Exception, match="25832"):
        geotiff.raster_pixels(files, 4326).count()


def test_enriched_features(spark):
    features = spark.createDataFrame([(0, {"a": "1", "b": "x"}), (1, {"a": "2"})], "ord int, properties map<string,string>")
    got = {r["ord"]: r["properties"] for r in readers.enriched_features(features, spark.createDataFrame([(0, 9, None)], "ord int, a int, c string")).collect()}
    assert got == {0: {"a": "9", "b": "x", "c": None}, 1: {"a": "2"}}


def test_graphml_of_odd_names(spark):
    edges = spark.createDataFrame([("z", 'a"&<', "b", "1", None, 2.0, None), ("z", "b", "a", "2", 3.0, None, None)], "zona string, src string, dst string, key string, travel_time double, walk_time_s double, length double")
    nodes, back = readers.graphml_parts(writers.graphml_documents(edges, "zona"))
    assert {(r["src"], r["dst"], r["key"], r["travel_time"], r["walk_time_s"]) for r in back.collect()} == {('a"&<', "b", "1", None, 2.0), ("b", "a", "2", 3.0, None)}
    assert {r["id"] for r in nodes.collect()} == {'a"&<', "b", "a"}


def test_graphml_of_many_edges(spark):
    """A large network becomes several whole documents, which hold every edge once."""
    k = F.col("id")
    edges = spark.range(12_000).select(F.lit("z").alias("zona"), (k % 700).alias("src"), (k % 900).alias("dst"), k.cast("string").alias("key"), F.lit(None).cast("double").alias("travel_time"), k.cast("double").alias("walk_time_s"), F.lit(None).cast("double").alias("length"))
    documents = writers.graphml_documents(edges, "zona")
    assert documents.count() == 3 and documents.agg(F.max(F.length("content"))).first()[0] < 1_000_000
    nodes, back = readers.graphml_parts(documents)
    assert sorted((int(r["key"]), r["src"], r["dst"], r["walk_time_s"]) for r in back.collect()) == [(i, str(i % 700), str(i % 900), float(i)) for i in range(12_000)]
    assert {int(r["id"]) for r in nodes.collect()} == set(range(900))
