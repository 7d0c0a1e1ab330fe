import json
import math
import random
import zipfile
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentiero.functions import expressions as X
from sentiero.functions import geometry as G
from sentiero.operators import clustering, facets, graph, indices, joins, matching, ranking, raster, transit
from sentiero.operators.components import connected_components
from sentiero.sources import readers, writers


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def near(x):
    return x if x is None else pytest.approx(x, abs=1e-9)


@pytest.mark.parametrize(("text", "want"), [("1.234,5", 1234.5), ("1234.5", 1234.5), ("12.5", 12.5), ("12,5", 12.5), (" ", None), (None, None), ("None", None), ("Infinity", None)])
def test_italian_number(spark, text, want):
    assert one(spark, X.italian_number(F.lit(text).cast("string"))) == near(want)


@pytest.mark.parametrize(("text", "want"), [("24:10:00", 87000.0), ("07:00:00", 25200.0), ("7:60:00", None), ("", None), ("abc", None), ("07:00", None), (" 20:00:00 ", 72000.0), ("-1:00:00", None), (None, None)])
def test_clock(spark, text, want):
    assert one(spark, X.clock_seconds(F.lit(text).cast("string"))) == near(want)


def test_classes_at_their_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 5.0, 10.0, 15.0, 20.0, 20.1, 25.0, 50.0, 75.0, 100.0, None)], "v double")
    got = [tuple(r) for r in df.select(X.time_band(F.col("v")), X.bins(F.col("v"), X.SCORE_EDGES, X.SCORE_LABELS), X.bins(F.col("v"), X.SLOPE_EDGES, X.SLOPE_LABELS, right_closed=False)).collect()]
    assert got[0] == (None, "bassa", "<5") and got[1][::2] == ("0-5", "5-10") and got[4][0] == "15-20" and got[5][0] == ">20"
    assert [g[1] for g in got[6:10]] == ["bassa", "medio-bassa", "medio-alta", "alta"] and got[10] == (None, None, None)


def test_nulls_stay_null(spark):
    n = F.lit(None).cast("double")
    assert one(spark, X.clip(n, 0.0, 1.0)) is None and one(spark, X.safe_divide(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, X.finite(F.lit(float("nan")))) is None and one(spark, X.mean_of(n, n)) == 50.0 and one(spark, X.mean_of(n, F.lit(3.0))) == 3.0
    assert one(spark, X.grade(F.lit(5.0), F.lit(0.0))) == 0.0 and one(spark, X.truth_score(F.lit("x"))) == 50.0


def test_texts(spark):
    assert one(spark, X.snake_name(F.lit("  Tempo Cultura (min) "))) == "tempo_cultura_min"
    assert one(spark, X.plain_words(F.lit("Piazza Sprè, 12 Verona"), ["verona"])) == "piazza spre 12"
    assert one(spark, X.slug(F.lit("Seduta  del 3/4 – È"))) == "seduta-del-3-4-e"
    assert one(spark, X.route_name(F.lit(" 5.0 "))) == "5" or one(spark, X.route_name(F.lit("5.0"))) == "5"
    assert one(spark, X.join_key(F.lit("123.0"))) == "123"
    assert one(spark, X.decimal_comma(F.lit(2.25))) == "2,2" and one(spark, X.decimal_comma(F.lit(None).cast("double"))) == "n.d."
    assert one(spark, X.count_label(F.lit(1.4), "fermata", "fermate")) == "1 fermata" and one(spark, X.count_label(F.lit(2.5), "fermata", "fermate")) == "2 fermate"


def test_ranks(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 4.0, None])], "i int, v double")
    got = {r["i"]: r["s"] for r in ranking.percentile_score(df, "v", "s").collect()}
    assert got == {0: 25.0, 1: 62.5, 2: 62.5, 3: 100.0, 4: 50.0}
    same = df.where("v = 2")
    assert {r["s"] for r in ranking.percentile_score(same, "v", "s").collect()} == {50.0}
    assert ranking.percentile_score(df.limit(0), "v", "s").count() == 0
    many = spark.range(3000).select("id", (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    vals = sorted(r["v"] for r in many.collect())
    got = {r["v"]: r["s"] for r in ranking.percentile_score(many, "v", "s").collect()}
    assert all(got[float(x)] == pytest.approx(100 * (vals.index(x) + 2) / 3000) for x in (0, 1, 500, 999))
    both = ranking.percentile_scores(many.withColumn("w", F.col("v")), "id", ["v", "w"])
    assert both.where("id = 0").first()["v"] == pytest.approx(100 * 2 / 3000)


def test_scales_and_names(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i)) for i in range(101)], "i int, n string, v double")
    w = ranking.winsorize(df, ["v"]).agg(F.min("v"), F.max("v")).first()
    assert tuple(w) == (1.0, 99.0)
    z = {r["i"]: r["z"] for r in ranking.robust_z(df, "v", "z").collect()}
    assert z[50] == 0 and z[75] == pytest.approx(0.67448975)
    assert {r["z"] for r in ranking.robust_z(df.withColumn("v", F.lit(3.0)), "v", "z").collect()} == {0.0}
    names = {r["i"]: r["o"] for r in ranking.numbered_names(df, "n", "i", "o").collect()}
    assert names[0] == "b" and names[1] == "a" and names[3] == "a_2"
    assert [tuple(r) for r in ranking.quantile_breaks(df, "v", 4).orderBy("classe").collect()] == [(0, 0.0), (1, 25.0), (2, 50.0), (3, 75.0), (4, 100.0)]


def test_index_rounds_before_classes(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(1, 9)], "k int, a double, b double")
    got = {r["k"]: r for r in indices.composite_index(df, "k", {"score_servizi": ["a"]}, {"score_residenza": ["b"]}).collect()}
    assert got[8]["score_servizi"] == 100.0 and got[8]["indice_accessibilita"] == pytest.approx(0.4 * 100 + 0.35 * 50 + 0.25 * 50)
    assert got[8]["score_facilita_territoriale"] == 50.0 and got[1]["classe_accessibilita"] == "medio-bassa"


def test_joins(spark):
    a, b = spark.createDataFrame([("1.0", 5), ("2", 6)], "k string, x int"), spark.createDataFrame([(" 1", 7), ("1", 8)], "k string, x int")
    got = sorted(tuple(r) for r in joins.join_first(a, b, "k", "x").select("chiave", "x_geo", "x_istat", "trovato").collect())
    assert got == [("1", 5, 7, True), ("2", 6, None, False)]
    assert [r["k"] for r in joins.unmatched(a, b, "k").collect()] == ["2"]
    with pytest.raises(ValueError, match="repeats"):
        joins.join_unique(a, b.withColumn("k", F.trim("k")), "k")
    assert joins.resolve_column(["Tempo  Min", "x"], ["nope", "tempo_min"]) == "Tempo  Min"
    with pytest.raises(ValueError, match="none of"):
        joins.resolve_column(["x"], ["y"], required=True)


def test_calendar(spark):
    cal = spark.createDataFrame([("A", "20260101", "20261231", *"1111100"), ("B", "20260101", "20260301", *"1111111")], "service_id string, start_date string, end_date string, " + ", ".join(f"{d} string" for d in transit.WEEKDAYS))
    exc = spark.createDataFrame([("C", "20260715", 1), ("A", "20260715", 2)], "service_id string, date string, exception_type int")
    dates = spark.createDataFrame([("20260714",), ("20260715",), ("20260718",)], "date string")
    got = sorted(tuple(r) for r in transit.active_services(cal, exc, dates).collect())
    assert got == [("20260714", "A"), ("20260715", "C")]
    days = [spark.createDataFrame([(d, "x") for d in ds], "date string, service_id string") for ds in (["20260718", "20260720", "20260721"], ["20260718", "20260721"])]
    assert transit.common_weekday(days, "20260716").first()[0] == "20260721"


def test_headway(spark):
    df = spark.createDataFrame([("s", 25200.0, " 5 "), ("s", 28800.0, "A"), ("s", 72000.0, ""), ("s", 72000.1, "Z"), ("t", 30000.0, "5")], "stop_id string, seconds double, line string")
    got = {r["stop_id"]: r for r in transit.stop_passages(df, 25200, 72000).collect()}
    assert got["s"]["passaggi"] == 3 and got["s"]["frequenza_media_min"] == 390.0 and got["s"]["linee"] == "5,A"
    assert got["t"]["frequenza_media_min"] is None


def test_greedy_merge_isn_t_transitive(spark):
    rnd = random.Random(9)
    pts = [(i, i, rnd.uniform(0, 400), rnd.uniform(0, 400)) for i in range(120)] + [(500 + i, 500 + i, 1000.0 + 30 * i, 0.0) for i in range(6)]
    df = spark.createDataFrame(pts, "id bigint, ord bigint, x double, y double")
    got = {r["id"]: r["cluster"] for r in transit.merge_stops(df, 35.0).collect()}
    want, free = {}, {p[0]: p for p in pts}
    for i, _, x, y in pts:
        if i in free:
            for j, _, u, v in list(free.values()):
                if (x - u) ** 2 + (y - v) ** 2 <= 35.0**2:
                    want[j] = i
                    del free[j]
    assert got == want and len({want[500 + i] for i in range(6)}) == 3
    assert {r["id"]: r["cluster"] for r in transit.merge_stops(df, 35.0, chain_stops=3).collect()} == want


def test_components_and_paths(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(120), rnd.randrange(120), rnd.uniform(1, 9)) for _ in range(110)] + [(300 + i, 301 + i, 1.0) for i in range(40)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, t double")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert {r["id"]: r["component"] for r in connected_components(df).collect()} == {v: find(v) for v in list(parent)}
    assert connected_components(df.limit(0)).count() == 0
    seeds = spark.createDataFrame([(0, e[0], 0.0) for e in edges[:3]], "source int, id bigint, cost double")
    got = {r["id"]: r["cost"] for r in graph.shortest_paths(df, seeds).collect()}
    cost = {e[0]: 0.0 for e in edges[:3]}
    for _ in range(200):
        for a, b, t in edges:
            if a in cost and cost[a] + t < cost.get(b, math.inf):
                cost[b] = cost[a] + t
    assert got.keys() == cost.keys() and all(abs(got[k] - cost[k]) < 1e-9 for k in cost)
    assert {r["id"] for r in graph.shortest_paths(df, seeds, cutoff=5.0).collect()} == {k for k, c in cost.items() if c <= 5}
    main = graph.largest_component(df).collect()
    sizes = {}
    for v in parent:
        sizes[find(v)] = sizes.get(find(v), 0) + 1
    assert {find(r["src"]) for r in main} == {max(sizes, key=lambda c: (sizes[c], -c))}


def test_network_building(spark):
    line = spark.createDataFrame([(1, [(0.0, 0.0), (60.0, 0.0), (60.0, 40.0)])], "line_id int, line array<struct<x:double,y:double>>")
    pts = graph.densify(line).orderBy("seq").collect()
    assert [(round(p["x"], 6), round(p["y"], 6)) for p in pts] == [(0, 0), (25, 0), (50, 0), (60, 15), (60, 40)]
    seg = spark.createDataFrame([(0.0, 0.0, 0.0, 100.0, 0.0, 10.0, False), (0.0, 0.0, None, 0.2, 0.0, 0.0, False), (100.0, 0.0, 0.0, 0.0, 0.0, 0.0, True)], "x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, stairs boolean")
    e = {(r["src"], r["dst"]): r for r in graph.walking_edges(seg).collect()}
    up = 0.1 / (6 * math.exp(-3.5 * 0.15)) * 60
    assert e["0.0_0.0", "100.0_0.0"]["t"] == pytest.approx(min(up, 0.1 / 1.8 * 60)) and len(e) == 2
    nodes = spark.createDataFrame([("a", 0, 0.0, 0.0), ("b", 1, 0.0, 2.0), ("c", 2, 900.0, 0.0)], "node string, ord int, x double, y double")
    p = spark.createDataFrame([(1, 0.0, 1.0), (2, 500.0, 0.0)], "id int, x double, y double")
    assert {r["id"]: (r["node"], r["metri"]) for r in graph.nearest_node(p, nodes, 5.0).collect()} == {1: ("a", 1.0), 2: ("c", 400.0)}
    assert [r["id"] for r in graph.nearest_node(p, nodes, 5.0, most=250.0).collect()] == [1]


def test_geometry(spark):
    square = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    assert one(spark, G.area(square)) == 16 and one(spark, G.perimeter(square)) == 16 and tuple(one(spark, G.centroid(square))) == (2, 2)
    at = lambda f, x, y: one(spark, f(square, F.lit(float(x)), F.lit(float(y))))
    assert at(G.within, 2, 2) and not at(G.within, 4, 2) and at(G.covers, 4, 2) and not at(G.covers, 5, 2)
    assert at(G.distance_to, 7, 8) == 5 and at(G.distance_to, 1, 1) == 0
    line = lambda *ps: F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ps])
    assert one(spark, G.line_meets(line((-1, 2), (9, 2)), square)) and not one(spark, G.line_meets(line((5, 5), (9, 2)), square))
    xy = one(spark, G.to_metric(F.lit(46.0664), F.lit(11.15)))
    assert xy["x"] == pytest.approx(666_300, abs=600) and xy["y"] == pytest.approx(5_103_700, abs=900)
    back = one(spark, G.to_degrees(F.lit(xy["x"]), F.lit(xy["y"])))
    assert back["lat"] == pytest.approx(46.0664, abs=1e-7) and back["lon"] == pytest.approx(11.15, abs=1e-7)
    mid = one(spark, G.to_metric(F.lit(46.0), F.lit(9.0)))
    assert mid["x"] == pytest.approx(500_000, abs=1e-6) and mid["y"] == pytest.approx(5_093_988, abs=700)


def test_raster(spark):
    px = spark.createDataFrame([(r, c, float(3 * c + 2 * r)) for r in range(5) for c in range(6)], "row int, col int, v double")
    g = raster.gradient(px, 1.0).collect()
    assert {(round(r["dz_dx"], 9), round(r["dz_dy"], 9)) for r in g} == {(3.0, 2.0)}
    s = raster.sample_points(spark.createDataFrame([(1, 2.5, -1.5), (2, 99.0, 0.0)], "id int, x double, y double"), px, 0.0, 0.0, 1.0)
    assert {r["id"]: r["v"] for r in s.collect()} == {1: 8.0, 2: None}
    z = raster.zonal_stats(spark.createDataFrame([(1, v) for v in (1.0, 2.0, 2.0, 4.0)], "zone int, v double"), spark.createDataFrame([(1,), (2,)], "zone int")).collect()
    assert {r["zone"]: (r["n"], r["mediana"], r["p25"]) for r in z} == {1: (4, 2.0, 1.75), 2: (0, None, None)}
    holes = px.where("not (row = 2 and col = 2)")
    filled = raster.fill_gaps(holes, px.select("row", "col")).where("row = 2 and col = 2").first()
    assert filled["v"] == pytest.approx(10.0, abs=1.0)
    assert one(spark, raster.hillshade(F.lit(0.0), F.lit(0.0))) == pytest.approx(255 * math.sin(math.pi / 4))


def test_fuzzy_scores():
    assert matching.indel_ratio("abcd", "abcd") == 100 and matching.indel_ratio("abcd", "bcde") == pytest.approx(75.0)
    assert matching.token_set_ratio("bar roma", "bar roma centro") == 100 and matching.partial_ratio("roma", "bar roma centro") == 100
    assert matching.token_sort_ratio("a b c", "c b a") == 100 and matching.weighted_ratio("", "x") == 0
    assert matching.pair_score("bar roma", "via x 1", "bar roma", "via x 1") == pytest.approx(100)
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(9))) for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        if a and b:
            assert matching.indel_ratio(a, b) == pytest.approx(200 * row[-1][-1] / (len(a) + len(b)))


def test_fuzzy_candidates_against_all_pairs(spark):
    rnd = random.Random(5)
    proper = ["".join(rnd.choice("abdefilmoprstuvz") for _ in range(rnd.randrange(4, 11))) for _ in range(25)]
    kinds = ["circolo ricreativo", "associazione sportiva", "bar", "soc coop soc", "", "farmacia", "scuola dell infanzia"]

    def text():
        w = list(rnd.choice(proper))
        if rnd.random() < 0.3:
            w[rnd.randrange(len(w))] = rnd.choice("aeiou")
        return f"{rnd.choice(kinds)} {''.join(w)} {rnd.choice(['', '', rnd.choice(proper)])}".strip().replace("  ", " ")

    def place():
        return rnd.choice(["", f"via {rnd.choice(proper)} {rnd.randrange(30)}", f"{rnd.choice(proper)} piazza {rnd.choice(proper)} n 3"])

    s = [(i, text(), place()) for i in range(80)] + [(100, "circolo ricreativo zudicefoto", ""), (101, "", ""), (102, "a" * 70, "via b 1"), (103, "associazione sportiva ribelodife", "")]
    p = [(i, text(), place()) for i in range(400)] + [(5043, "zudicefoto", ""), (3523, "ribelodife", ""), (3524, "", "via b 1"), (3525, "a" * 69, "")]
    got = {}
    for r in matching.fuzzy_candidates(spark.createDataFrame(s, "service_row int, name string, address string"), spark.createDataFrame(p, "poi_id int, name string, address string"), 60.0, 5).orderBy("service_row", "rank").collect():
        got.setdefault(r["service_row"], []).append((r["score"], r["poi_id"]))
    for row, name, address in s:
        want = sorted(((round(matching.pair_score(name, address, n, a), 6), i) for i, n, a in p), reverse=True)
        assert got.get(row, []) == [w for w in want if w[0] >= 60][:5]


def test_fuzzy_parts_of_many_pairs():
    rnd = random.Random(3)
    text = lambda n: " ".join("".join(rnd.choice("aeimnorst") for _ in range(rnd.randrange(1, 8))) for _ in range(rnd.randrange(1, n)))
    a, b = ([text(n) for n in (3, 6, 9, 16) for _ in range(40)] for _ in range(2))
    x, y = matching._Compared(a), matching._Compared(b)
    i, j = (np.array([rnd.randrange(160) for _ in range(3000)]) for _ in range(2))
    got = matching._partials(x.raw, x.length, i, y.raw, y.length, j)
    assert got.tolist() == [matching.partial_ratio(a[p], b[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)]


def test_fuzzy_scores_without_python_pairs(monkeypatch):
    """Plain texts of any length, also with repeated words, are scored by arrays over many pairs: pair by pair it took too long."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abdeilmorstuvz") for _ in range(rnd.randrange(2, 11))) for _ in range(60)] + ["bar", "via", "di", "circolo"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, n)))
    place = lambda: rnd.choice(["", text(6), text(16)[:120].strip()])
    s = [(i, text(rnd.choice([3, 6, 14])), place()) for i in range(60)]
    p = [(i * 7 % 1009, text(rnd.choice([3, 6, 14])), place()) for i in range(700)]
    want = {i: sorted(((x, j) for j, n, a in p if (x := round(matching.pair_score(name, address, n, a), 6)) >= 60), reverse=True)[:6] for i, name, address in s}
    monkeypatch.setattr(matching, "pair_score", None)
    asked, got = matching.Services(*map(list, zip(*s, strict=True)), 60.0), {}
    for part in (p[:300], p[300:]):
        block = matching.PoiBlock(*map(list, zip(*part, strict=True)))
        for i, x, j in asked.best(block, 6):
            got.setdefault(i, []).append((x, block.ids[j]))
    assert {i: sorted(g, reverse=True)[:6] for i, g in got.items()} == {i: w for i, w in want.items() if w}


def test_best_external_against_all_pairs(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abdefilmoprstuvz") for _ in range(rnd.randrange(3, 10))) for _ in range(30)]
    some = lambda i: (i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))), 46.06 + rnd.random() / 100, 11.15 + rnd.random() / 100)
    base = [some(i) for i in range(150)] + [(900, "rossi bar", 46.0, 11.0), (901, "x" * 60 + " uno", 46.5, 11.5), (902, "x" * 60 + " due", 46.5, 11.5), (903, "", 46.7, 11.7)]
    ext = [some(i) for i in range(60)] + [(800, "bar rossi", 46.0, 11.0), (801, "x" * 60 + " due", 46.5, 11.5), (802, "9", 47.0, 12.0), (803, "", 46.7, 11.7)]
    schema = "{} int, name string, lat double, lon double"
    b, e = spark.createDataFrame(base, schema.format("base_id")), spark.createDataFrame(ext, schema.format("ext_id"))
    got = {r["ext_id"]: (r["base_id"], r["score"]) for r in matching.best_external(b, e).collect()}

    def score(x, y):
        la, lo, lb, lob = map(math.radians, (x[2], x[3], y[2], y[3]))
        d = 2 * 6_371_000 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lob - lo) / 2) ** 2))
        return 0.72 * SequenceMatcher(None, x[1], y[1]).ratio() + 0.28 * max(0.0, 1 - d / 250)

    for x in ext:
        top = max(score(x, y) for y in base)
        assert got[x[0]][1] == pytest.approx(top, abs=1e-6) and score(x, next(y for y in base if y[0] == got[x[0]][0])) == pytest.approx(top, abs=1e-6)
    assert got[800][0] == 900 and got[801][0] == 902 and got[802]
    empty = matching.best_external(b.limit(0), e).collect()
    assert len(empty) == len(ext) and all(r["base_id"] is None for r in empty)


def test_status(spark):
    rows = [(86.0, 4.0), (86.0, 3.9), (94.0, 0.0), (85.9, 50.0), (None, None)]
    df = spark.createDataFrame(rows, "b double, g double")
    assert [r[0] for r in df.select(matching.match_status(F.col("b"), F.col("g"))).collect()] == ["automatico", "da_verificare", "automatico", "da_verificare", "non_trovato"]


def test_ward_and_silhouette(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.2, (n, 2)) for c, n in ((0, 12), (5, 7), (9, 3))])
    label = clustering.ward_labels(x, 3)
    assert [len(set(label[a:b])) for a, b in ((0, 12), (12, 19), (19, 22))] == [1, 1, 1] and len(set(label)) == 3
    assert clustering.silhouette(x, label) > 0.8 and clustering.silhouette(x, np.ones(len(x), int)) == 0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k int, a double, b double")
    got = {r["k"]: r["cluster"] for r in clustering.ward_groups(df, "k", ["a", "b"], 3).collect()}
    assert [got[i] for i in range(len(x))] == list(label)


def test_facets(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), (None, "p")], "a string, b string")
    got = {(r["dimensione"], r["valore"]): r["n"] for r in facets.facet_counts(df, ["a", "b"], {"a": ["x"], "b": ["p"]}).collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 1, ("a", facets.MISSING): 1, ("b", "p"): 1, ("b", "q"): 1}


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("stops.txt", "﻿stop_id,stop_name\n1,A\n2,\n")
    got = [(r["stop_id"], r["stop_name"], r["stop_lat"]) for r in readers.gtfs_table(spark, str(tmp_path / "*.zip"), "stops.txt", ["stop_id", "stop_name", "stop_lat"]).collect()]
    assert got == [("1", "A", ""), ("2", "", "")]
    assert readers.gtfs_table(spark, str(tmp_path / "*.zip"), "shapes.txt", ["shape_id"], required=False).count() == 0
    (tmp_path / "a.csv").write_text('﻿nome;nota\n"Bar; Roma";"riga\nuna"\n')
    assert [tuple(r) for r in readers.sniffed_csv(spark, str(tmp_path / "a.csv")).collect()] == [("Bar; Roma", "riga\nuna")]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2]]]}, "properties": {"n": "x"}}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    f = readers.geojson_features(spark, str(tmp_path / "g.json"))
    ring = f.select(readers.rings_of(F.col("geometry_type"), F.col("coordinates"))[0].alias("r"), F.col("properties")["n"].alias("n")).first()
    assert [tuple(p) for p in ring["r"]] == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)] and ring["n"] == "x"
    with pytest.raises(ValueError, match="degrees"):
        readers.check_degrees(spark.createDataFrame([(660000.0, 5100000.0)], "x double, y double"))
    (tmp_path / "n.graphml").write_text('<graphml xmlns="u"><key id="d0" attr.name="x"/><key id="d1" attr.name="length"/><graph><node id="1"><data key="d0">3.5</data></node><edge source="1" target="2"><data key="d1">12</data></edge></graph></graphml>')
    nodes, edges = readers.graphml(spark, str(tmp_path / "n.graphml"))
    assert nodes.first()["x"] == 3.5 and graph.repaired_weights(edges).first()["walk_time_s"] == 10.0
    poi = spark.createDataFrame([("42,0", None, "POINT (7.5 42.5)", None), (None, None, None, '{"coordinates":[8,43]}'), ("1", "2", None, None)], "a string, o string, w string, g string")
    at = [tuple(r[0]) for r in poi.select(readers.poi_position(F.col("a"), F.col("o"), F.col("w"), F.col("g"))).collect()]
    assert at == [(42.5, 7.5), (43.0, 8.0), (1.0, 2.0)]


def test_geopackage(spark, tmp_path):
    import sqlite3
    import struct

    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('stops', 'geom')")
    db.execute("CREATE TABLE stops (fid INTEGER, geom BLOB, nome TEXT)")
    db.execute("INSERT INTO stops VALUES (1, ?, 'x'), (2, NULL, NULL)", (b"GP\x00\x01" + struct.pack("<i", 4326) + struct.pack("<bIdd", 1, 1, 7.5, 42.5),))
    db.commit()
    db.close()
    rows = {r["fid"]: r for r in readers.geopackage(spark, str(tmp_path / "a.gpkg"), "stops").collect()}
    assert readers.wkb_point(bytes(rows[1]["geom"])) == (7.5, 42.5) and rows[1]["attributes"]["nome"] == "x" and rows[2]["geom"] is None


def test_sinks_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 7.0, 42.0)], "id int, x double, y double")
    writers.write_geojson_lines(df, str(tmp_path / "o"), "Point", F.array("x", "y"), ["id"])
    assert json.loads(spark.read.text(str(tmp_path / "o")).first()[0]) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [7.0, 42.0]}, "properties": {"id": 1}}
    writers.write_table(df.withColumn("geom", F.lit("g")), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == ["id", "x", "y"]
    writers.write_metadata(spark, str(tmp_path / "m"), {"a": 1})
    from sentiero.streaming.passages import run_to_end, windowed_passages

    src = spark.createDataFrame([(f"2026-01-0{1 + i % 2} 0{i % 9}:10:00", "k") for i in range(20)], "t string, key string").select(F.col("t").cast("timestamp").alias("t"), "key")
    src.write.parquet(str(tmp_path / "s"))
    batch = {tuple(r) for r in windowed_passages(src, "t", "key").collect()}
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "s"))
    assert {tuple(r) for r in run_to_end(windowed_passages(stream, "t", "key"), "passages_test", str(tmp_path / "c")).collect()} == batch


def test_small_operators(spark):
    assert one(spark, X.date_in_title(F.lit("Seduta di lunedì 3 marzo"))) == "lunedì 3 marzo" and one(spark, X.date_in_title(F.lit("Seduta"))) is None
    assert X.add_missing(spark.createDataFrame([(1, 2)], "lat int, x int"), {"latitude": "lat", "x": "lat", "z": "none"}).columns == ["lat", "x", "latitude"]
    pts = spark.createDataFrame([("a", float(x), float(y)) for x in range(9) for y in range(9)] + [("b", 1.0, 1.0)], "k string, x double, y double")
    hulls = {r["k"]: {tuple(p) for p in r["hull"]} for r in G.convex_hulls(pts, "k").collect()}
    assert hulls == {"a": {(0, 0), (8, 0), (8, 8), (0, 8)}, "b": {(1, 1)}}
    ring = lambda *ps: F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ps])
    assert one(spark, G.is_simple_ring(ring((0, 0), (2, 0), (2, 2)))) and not one(spark, G.is_simple_ring(ring((0, 0), (2, 2), (2, 0), (0, 2))))
    grid = [tuple(r) for r in G.covering_grid(spark, 42.0, 42.02, 7.0, 7.03, 400.0).collect()]
    from sentiero.functions.kdtree import haversine_m

    for lat in np.linspace(42.0, 42.02, 9):
        for lon in np.linspace(7.0, 7.03, 9):
            assert min(haversine_m(np.array([g[0] for g in grid]), np.array([g[1] for g in grid]), lat, lon)) <= 401
    stops = spark.createDataFrame([("n", "s1", 5, 1), ("n", "s2", 5, 2), ("m", "s3", 1, 3)], "node string, stop_id string, passaggi int, ord int")
    assert {tuple(r) for r in graph.best_stop_of_node(stops).collect()} == {("n", "s1"), ("m", "s3")}
    e = graph.edge_times(spark.createDataFrame([(1, 2)], "src int, dst int"), spark.createDataFrame([(1, 4.0), (2, 8.0)], "id int, t double"))
    assert e.first()["media"] == 6.0


def test_densified_lines_of_repeated_ids(spark):
    """Rows with one id are lines of their own."""
    ends = [[(0.0, 0.0), (100.0, 0.0)], [(0.0, 50.0), (30.0, 50.0), (30.0, 70.0)], [(0.0, 0.0), (100.0, 0.0)]]
    lines = spark.createDataFrame([(1, line) for line in ends], "line_id int, line array<struct<x double,y double>>")
    got = sorted((r["seq"], r["x"], r["y"]) for r in graph.densify(lines).collect())
    assert got == sorted(2 * [(i, 25.0 * i, 0.0) for i in range(5)] + [(0, 0.0, 50.0), (1, 25.0, 50.0), (2, 30.0, 70.0)])


def test_nearness_within_reach_only():
    """Nearness is computed for the rows within reach in latitude; impossible and missing latitudes are compared as before."""
    rnd = np.random.default_rng(3)

    def all_rows(lats, lons, lat, lon):
        la, lo, x, y = (np.radians(np.array(v, float)) for v in (lats, lons, lat, lon))
        a = np.sin((la - x) / 2) ** 2 + np.cos(x) * np.cos(la) * np.sin((lo - y) / 2) ** 2
        return np.nan_to_num(np.maximum(0.0, 1 - 2 * matching.EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, a))) / 250.0))

    for odd in ([], [None], [406.0, None]):
        lats = [*(46 + rnd.uniform(-0.01, 0.01, 300)).tolist(), *odd]
        lons = [*(11 + rnd.uniform(-0.01, 0.01, 300)).tolist(), *(11.0 for _ in odd)]
        block = matching.BaseBlock(list(range(len(lats))), ["x"] * len(lats), lats, lons)
        for lat, lon in ((46.0, 11.0), (lats[7], lons[7]), (46.0, np.nan), (np.nan, 11.0), (406.0, 11.0)):
            assert np.allclose(block._near(np.radians(lat), np.radians(lon), 250.0), all_rows(lats, lons, lat, lon), atol=1e-12)
