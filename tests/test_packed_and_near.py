import numpy as np
import pytest
from pyspark.sql import functions as F

from sentiero.functions.coords import degrees_of, position_of, usual_region
from sentiero.functions.kdtree import Splits, chord, haversine_m, pairs_within, unit_vectors
from sentiero.functions.packed import split_packed
from sentiero.operators.nearby import in_regions, within_distance
from sentiero.operators.packed_lists import explode_packed

PACKED = [
    (None, []),
    ("", []),
    (" \t", []),
    ("-", []),
    ("n.d.", []),
    ("nessuna", []),
    ("[]", []),
    ("7", ["7"]),
    (" 7/,14,1", ["7/", "14", "1"]),
    ("12/;;11|C-2,", ["12/", "11", "C-2"]),
    ('"Navetta, festiva";5/', ["Navetta, festiva", "5/"]),
    ('"Corsa ""Rossa""";9', ['Corsa "Rossa"', "9"]),
    ('["Corsa \\"Rossa\\"", "x"]', ['Corsa "Rossa"', "x"]),
    ("'Valle dell''Orma','9'", ["Valle dell'Orma", "9"]),
    ("Valle dell'Orma / Linea Verde", ["Valle dell'Orma", "Linea Verde"]),
    ("X410/ / X401", ["X410/", "X401"]),
    ("1 e 2 e 3", ["1", "2", "3"]),
    ("17 barrato", ["17 barrato"]),
    ("1819 1818", ["1819", "1818"]),
    ('"1805" "1804"', ["1805", "1804"]),
    ('{5/,"Alpe - Fondo"}', ["5/", "Alpe - Fondo"]),
    ("a0x,b", ["a0x", "b"]),
    ("x," * 3000 + "y", ["x"] * 3000 + ["y"]),
]


def test_split_packed(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PACKED)], "i int, t string")
    got = {r["i"]: [v["valore"] for v in r["v"]] for r in df.select("i", split_packed(F.col("t")).alias("v")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PACKED)}


def test_explode_packed_edges(spark):
    rows = [(1, "a,b", None, 1), (1, "a,b", None, 2), (None, "c", "d", 1), (2, "z", "y", None)]
    df = spark.createDataFrame(rows, "k bigint, f string, campo string, t int")
    got = sorted(tuple(r) for r in explode_packed(df, "k", ["f", "campo"], "t").collect())
    assert got == [(1, "f", 1, "a"), (1, "f", 2, "b"), (2, "campo", 1, "y"), (2, "f", 1, "z")]
    assert explode_packed(df.limit(0), "k", ["f"], "t").count() == 0


@pytest.mark.parametrize(("text", "want"), [("42.5", 42.5), ("42,5", 42.5), ("+42.5", 42.5), (" N 42.5", 42.5), ("lat 42.5", 42.5), ("42.5°", 42.5), ("42.5 N", 42.5), ("42°30'00.0\"N", 42.5), ("7°30'\"", 7.5), ("7.5 W", -7.5), ("-7.5", -7.5), ("42500000", 42500000.0), ("", None), ("-", None), ("abc", None), (None, None)])
def test_degrees(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(degrees_of(F.col("t"))).first()[0] == (want if want is None else pytest.approx(want))


def test_positions_as_meant(spark):
    base = [(42.0 + i / 100, 7.0 + i / 100) for i in range(20)]
    df = spark.createDataFrame(base + [(7.05, 42.05), (42050000.0, 7050000.0), (0.0, 0.0), (float("nan"), 7.0), (None, 7.0), (-33.0, 151.0), (95.0, 400.0)], "a double, o double")
    region = usual_region(df, F.col("a"), F.col("o"))
    got = [None if r["p"] is None else (round(r["p"]["lat"], 4), round(r["p"]["lon"], 4)) for r in df.select(position_of(F.col("a"), F.col("o"), region).alias("p")).collect()][20:]
    assert got == [(42.05, 7.05), (42.05, 7.05), None, None, None, (-33.0, 151.0), None]
    assert usual_region(df.limit(0), F.col("a"), F.col("o")) is None


def test_kdtree_against_brute_force():
    rng = np.random.default_rng(3)
    lat, lon = rng.uniform(41, 43, 700), rng.uniform(6, 8, 700)
    lat[:200], lon[:200] = 42.0, 7.0  # a crowd on one spot
    v, r = unit_vectors(lat, lon), chord(15_000)
    got = {(int(q), int(p)) for a, b in pairs_within(v[:300], v, r) for q, p in zip(a, b, strict=True)}
    d = haversine_m(lat[:300, None], lon[:300, None], lat[None], lon[None])
    want = {(int(q), int(p)) for q, p in zip(*np.nonzero(d <= 15_000), strict=True)}
    assert want <= got and len(got - want) <= 2
    s = Splits(v, 50)
    row, leaf = s.reach(v, 0.0)
    assert sorted(row) == list(range(700)) and s.leaves > 4 and leaf.max() < s.leaves


def test_within_distance(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(42, 42.05, 400), rng.uniform(7, 7.05, 400), strict=True))]
    pts += [(1000 + i, 42.01, 7.01) for i in range(50)] + [(2000, None, 7.0), (None, 42.0, 7.0), pts[0]]
    df = spark.createDataFrame(pts, "id bigint, lat double, lon double")
    got = {(r["left_id"], r["right_id"]) for r in within_distance(df, df, 300.0, leaf_points=60).collect()}
    ok = [p for p in set(pts) if p[0] is not None and p[1] is not None]
    a = np.array([p[1] for p in ok]), np.array([p[2] for p in ok])
    d = haversine_m(a[0][:, None], a[1][:, None], a[0][None], a[1][None])
    assert got == {(ok[i][0], ok[j][0]) for i, j in zip(*np.nonzero(d <= 300), strict=True)}
    assert within_distance(df.limit(0), df, 300.0).count() == 0


def test_in_regions(spark):
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rings = spark.createDataFrame([(1, ring(0.0, 0.0, 4.0)), (2, ring(2.0, 2.0, 4.0)), (1, ring(1.0, 1.0, 1.0)), (None, ring(0.0, 0.0, 9.0)), (3, ring(0.0, 0.0, 1.0)[:2])], "region bigint, ring array<struct<x:double,y:double>>")
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1, 7, (500, 2)))] + [(900, None, 1.0)]
    points = spark.createDataFrame(pts, "id bigint, x double, y double")
    inside = lambda x, y, a, b, s: a <= x < a + s and b <= y < b + s
    want = {(i, 1) for i, x, y in pts if x is not None and inside(x, y, 0, 0, 4) and not inside(x, y, 1, 1, 1)} | {(i, 2) for i, x, y in pts if x is not None and inside(x, y, 2, 2, 4)}
    for block in (100_000, 40):
        assert {tuple(r) for r in in_regions(points, rings, 1.5, block).collect()} == want
    assert in_regions(points.limit(0), rings, 1.0).count() == 0
