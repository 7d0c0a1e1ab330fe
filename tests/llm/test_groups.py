import numpy as np
from pyspark.sql import functions as F

from sentiero.llm.section_profile import SECTION_FEATURES
from sentiero.llm.similarity_groups import agree, communities, describe, similarity_groups

NAMES = [f.name for f in SECTION_FEATURES]


def _rows(seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(40):
        centre = np.exp(rng.uniform(2, 6, 12))
        for _ in range(1 + g % 7):
            v = centre * rng.uniform(0.97, 1.03, 12)
            if rng.uniform() < 0.3:
                v[rng.integers(12)] = np.nan
            if rng.uniform() < 0.2:
                v[6] *= 60
            if rng.uniform() < 0.1:
                v[3] = -9999
            rows.append((len(rows) + 1, *map(float, v)))
    return rows


def test_pairs_against_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([*rows, rows[0], (None, *rows[1][1:])], f"id bigint, {', '.join(f'{n} double' for n in NAMES)}").withColumn("v", F.lit("clash")).withColumn("community", F.lit(1))
    groups = similarity_groups(df, "id", SECTION_FEATURES)
    got = {tuple(r) for r in groups.pairs.collect()}
    m = np.array([r[1:] for r in rows])
    for k, f in enumerate(SECTION_FEATURES):
        m[~(m[:, k] >= f.least), k] = np.nan
    want = {(i + 1, j + 1) for i in range(len(m)) for j in range(i + 1, len(m)) if agree(m[i][None], m[j][None], SECTION_FEATURES, 8)[0]}
    assert len(want) > 50 and got <= want and len(got) >= 0.98 * len(want)
    about = describe(groups.members).collect()
    assert max(r["members"] for r in about) == 7 and all(1 <= len(r["typical"]) <= 3 for r in about)


def test_copies_and_empty(spark):
    row = tuple(float(10 + i) for i in range(12))
    df = spark.createDataFrame([(i, *row) for i in range(300)] + [(999, *[None] * 12)], f"id bigint, {', '.join(f'{n} double' for n in NAMES)}")
    assert similarity_groups(df, "id", SECTION_FEATURES).pairs.count() == 300 * 299 // 2
    empty = similarity_groups(df.limit(0), "id", SECTION_FEATURES)
    assert empty.pairs.count() == 0 and empty.members.count() == 0


def test_sparse_records_take_no_part(spark):
    """Records with fewer attributes than must be shared make no group, however many they are."""
    rows = [(i, *[None] * 12) for i in range(500)] + [(1000 + i, *[5.0] * 3, *[None] * 9) for i in range(50)]
    groups = similarity_groups(spark.createDataFrame(rows, f"id bigint, {', '.join(f'{n} double' for n in NAMES)}"), "id", SECTION_FEATURES)
    assert groups.members.count() == 0 and groups.pairs.count() == 0


def test_leaves_are_cut_in_the_task(spark, monkeypatch):
    """A small sample makes large leaves, which are cut again: the neighbours found stay the same in quality."""
    from sentiero.llm import similarity_groups as S

    rng = np.random.default_rng(8)
    m = np.repeat(np.exp(rng.uniform(2, 5, (120, 12))), 10, axis=0) * rng.uniform(0.9, 1.1, (1200, 12))
    points = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id bigint, v array<double>")
    monkeypatch.setattr(S, "SAMPLE_ROWS", 40)
    got = {}
    for r in S.neighbour_descent(points, SECTION_FEATURES, k=8, leaf=64).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    hits = total = 0
    for i in range(0, 1200, 25):
        d = S.distance(m[i][None], m, SECTION_FEATURES)
        d[i] = np.inf
        near = set(np.argsort(d)[:8].tolist())
        hits, total = hits + len(near & got[i]), total + len(near)
    assert hits >= 0.9 * total


def test_communities_of_cliques(spark):
    edges = [(10 * g + i, 10 * g + j, 1.0) for g in range(6) for i in range(6) for j in range(i + 1, 6)] + [(10 * g, 10 * g + 10, 0.05) for g in range(5)]
    got = communities(spark.createDataFrame(edges, "a bigint, b bigint, w double")).groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("m")).collect()
    assert sorted(tuple(r["m"]) for r in got) == [tuple(10 * g + i for i in range(6)) for g in range(6)]
