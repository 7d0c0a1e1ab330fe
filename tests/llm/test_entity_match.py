import math
import random

import numpy as np

from sentiero.llm.entity_match import B, K1, bm25_candidates, fit_logistic, match_entities

SCHEMA = "id bigint, name_tokens array<bigint>, name_boosts array<float>, place_tokens array<bigint>, place_boosts array<float>"


def _brute(queries, docs, k, within, share):
    """Scores of all pairs by the formula, cut to each query's k best with ties and those within the share of its best."""
    by, sizes = {}, {}
    for i, t, boost, name in docs:
        by.setdefault(i, {})[t] = (boost, name)
    for d, ts in by.items():
        for name in (True, False):
            sizes[d, name] = sum(n == name for _, n in ts.values())
    of = lambda name: [x for (_, m), x in sizes.items() if m == name and x]
    avg = {name: sum(of(name)) / len(of(name)) for name in (True, False) if of(name)}
    n = max(len(of(name)) for name in (True, False))
    df = {}
    for ts in by.values():
        for t in ts:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    weight = {d: {t: boost * idf[t] * (K1 + 1) / (1 + K1 * (1 - B + B * sizes[d, name] / avg[name])) for t, (boost, name) in ts.items()} for d, ts in by.items()}
    bound = {t: max(w[t] for w in weight.values() if t in w) for t in df}
    asked = {}
    for i, t, boost, name in queries:
        asked.setdefault(i, []).append((t, name, bound.get(t, boost * math.log(1 + (n + 0.5) / 0.5))))
    out = {}
    for q, ts in asked.items():
        theta = share * sum(ub for _, name, ub in ts if name)
        if not any(name for _, name, _ in ts):
            continue
        of = lambda w, kind: sum(w.get(t, 0.0) for t, name, _ in ts if name == kind)  # noqa: B023, E731
        scores = {d: of(w, True) + of(w, False) for d, w in weight.items() if of(w, True) >= theta - 1e-4 and of(w, True) > 0}
        best = sorted(scores.values(), reverse=True)
        for d, s in scores.items():
            if s >= best[min(k, len(best)) - 1] - 1e-5 or s >= within * best[0] - 1e-5:
                out[q, d] = s
    return out


def _table(spark, rows):
    by = {}
    for i, t, boost, name in rows:
        by.setdefault(i, ([], [], [], []))
        by[i][0 if name else 2].append(t)
        by[i][1 if name else 3].append(boost)
    return spark.createDataFrame([(i, *x) for i, x in by.items()], SCHEMA)


def test_top_k_is_exact(spark):
    rnd = random.Random(4)

    def make(n, base):
        rows = []
        for i in range(n):
            ts = {min(int(rnd.expovariate(0.08)), 90) for _ in range(6)}
            rows += [(base + i, t, 1.5 if t % 2 else 1.0, bool(t % 2)) for t in ts]
        return rows

    queries, docs = make(40, 0), make(120, 1000)
    q, d = _table(spark, queries), _table(spark, docs)
    for k, within, share in ((3, 0.9, 0.25), (1, 1.0, 0.5), (10, 0.5, 0.1)):
        got = {(r["q"], r["d"]): r["name"] + r["place"] for r in bm25_candidates(q, d, k, within, share).collect()}
        want = _brute(queries, docs, k, within, share)
        assert got.keys() == want.keys()
        assert all(abs(got[p] - want[p]) < 1e-3 for p in got)
    assert bm25_candidates(q, d.limit(0)).count() == 0 and bm25_candidates(q.limit(0), d).count() == 0


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.abs(fit_logistic(x, y) - [0.5, 2, -1]).max() < 0.25


def _places(seed, n):
    """Services and POIs of invented organisations with branches and homonyms, and the pairs that are one place."""
    rnd = random.Random(seed)
    syllables = [c + v for c in "bdfglmnprstvz" for v in "aeiou"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(5)).capitalize()
    kinds, streets = ["Farmacia", "Bar Trattoria", "Officina", "Biblioteca", "Palestra Comunale"], [word() for _ in range(n // 2)]
    services, pois, true = [], [], set()
    for o in range(n):
        name, kind = word(), rnd.choice(kinds)
        for branch in range(rnd.choice([1, 1, 1, 2])):
            at = (rnd.choice(streets), rnd.randint(1, 90))
            s, p = o * 10 + branch, 100_000 + o * 10 + branch
            typo = name[:6] + name[7:] if rnd.random() < 0.2 else name
            services.append((s, f"{kind} {name}", f"Via {at[0]} {at[1]}"))
            pois.append((p, f"{typo} ({kind}) srl", f"V. {at[0]}, {at[1]}"))
            true.add((s, p))
        if rnd.random() < 0.3:  # another organisation of the name's word at another place
            pois.append((200_000 + o, f"{rnd.choice([k for k in kinds if k != kind])} {name}", f"Via {rnd.choice(streets)} {rnd.randint(1, 90)}"))
    return services, pois, true


def test_matches_planted_places(spark):
    services, pois, true = _places(7, 400)
    schema = "id bigint, name string, address string"
    found = match_entities(spark.createDataFrame([*services, *services[:50]], schema), spark.createDataFrame(pois, schema)).collect()
    got = {(r["service_id"], r["poi_id"]) for r in found if r["matched"]}
    assert len(got & true) >= 0.9 * len(true) and len(got & true) >= 0.95 * len(got)
    assert len(found) == len({(r["service_id"], r["poi_id"]) for r in found}) and all(0 < r["confidence"] < 1 for r in found)


def test_missing_values(spark):
    services, pois, _ = _places(7, 100)
    schema = "id bigint, name string, address string"
    odd = [(9001, None, "Via Boracomuze 5"), (None, "Farmacia Lorguripade", "Via Boracomuze 5"), (9002, "", ""), (9003, "x" * 20_000, "y" * 20_000), (9004, "Farmacia Lorguripade", None)]
    s, p = spark.createDataFrame([*services, *odd], schema), spark.createDataFrame([*pois, (300_000, "Farmacia Lorguripade", "Via Boracomuze 5"), (300_001, None, None)], schema)
    got = {(r["service_id"], r["poi_id"]) for r in match_entities(s, p).where("matched").collect()}
    assert (9004, 300_000) in got and not any(a in (9001, 9002, 9003) for a, _ in got)
    assert match_entities(s.limit(0), p).count() == 0 and match_entities(s, p.limit(0)).count() == 0


def test_names_with_errors_at_both_ends(spark):
    """Names that share no word and no end of one are found by their place."""
    services, pois, true = _places(8, 200)
    swapped = lambda name: " ".join(w[:4] + w[5] + w[4] + w[6:] if len(w) == 10 else w for w in name.split(" "))
    pois = [(i, n if i // 10 % 3 else swapped(n), a) for i, n, a in pois]
    schema = "id bigint, name string, address string"
    found = match_entities(spark.createDataFrame(services, schema), spark.createDataFrame(pois, schema)).where("matched").collect()
    got = {(r["service_id"], r["poi_id"]) for r in found}
    assert len(got & true) >= 0.75 * len(true) and len(got & true) >= 0.95 * len(got)


def test_top_k_by_place_adds_only(spark):
    """What is found by place comes beside what is found by name, exact as well."""
    rows = [(1, 1, 1.0, True), (1, 11, 1.0, False), (1, 12, 1.0, False)]
    docs = [(100, 1, 1.0, True), (101, 2, 1.0, True), (101, 11, 1.0, False), (101, 12, 1.0, False), (102, 3, 1.0, True), (102, 13, 1.0, False)]
    q, d = _table(spark, rows), _table(spark, docs)
    plain = {(r["d"], round(r["name"], 4)) for r in bm25_candidates(q, d).collect()}
    both = {(r["d"], round(r["name"], 4)): r["named"] for r in bm25_candidates(q, d, place_share=0.25).collect()}
    assert plain == {x for x, named in both.items() if named} and {x for x, _ in plain} == {100}
    assert {x for (x, _), named in both.items() if not named} == {101}


def test_services_of_places_that_share_a_code(spark):
    """One name and street in two localities of one postal code are two places."""
    schema = "id bigint, name string, address string"
    services, pois, true = _places(9, 100)
    at = lambda i, p: f"Via Boracomuze {i}, 38100 {p}"
    filler = [(5000 + 10 * i + k, f"Palestra Comunale Sotobigure {i}", at(i, p)) for i in range(4) for k, p in enumerate(("Dugosudoza", "Mocagitevu"))]
    services = [*services, *filler, (9001, "Farmacia Lorguripade", at(7, "Dugosudoza")), (9002, "Farmacia Lorguripade", at(7, "Mocagitevu"))]
    pois = [*pois, (300_001, "Farmacia Lorguripade @ Dugosudoza", "Dugosudoza - via Boracomuze, 7"), (300_002, "Farmacia Lorguripade @ Mocagitevu", "Mocagitevu - via Boracomuze, 7")]
    found = match_entities(spark.createDataFrame(services, schema), spark.createDataFrame(pois, schema)).where("matched").collect()
    assert {(r["service_id"], r["poi_id"]) for r in found if r["service_id"] > 9000} == {(9001, 300_001), (9002, 300_002)}


def test_misspelt_beside_many_branches(spark):
    """A misspelt POI at the service's own place is found although more than k well-spelt branches score above it."""
    schema = "id bigint, name string, address string"
    services, pois, _ = _places(10, 100)
    services.append((9001, "Farmacia Lorguripade", "Via Boracomuze 5"))
    pois += [(300_000 + i, "Farmacia Lorguripade", f"Via {chr(66 + i)}otarimedu {10 + i}") for i in range(14)]
    pois.append((301_000, "Farmacia Lorguprade", "V. Boracomuze, 5"))
    found = match_entities(spark.createDataFrame(services, schema), spark.createDataFrame(pois, schema)).where("matched").collect()
    assert {r["poi_id"] for r in found if r["service_id"] == 9001} == {301_000}


def test_errors_at_both_ends_without_a_place(spark):
    """A name with a slip at either end and no address on one side is found by its consonants or its vowels."""
    schema = "id bigint, name string, address string"
    services, pois, _ = _places(11, 200)
    services += [(9001, "Farmacia Magerozase", None), (9002, "Officina Golupozata", "Via Boracomuze 5")]
    pois += [(300_001, "Farmacia Magroazse", "Via Boracomuze 7"), (300_002, "Officina Goupzoata", None)]
    found = match_entities(spark.createDataFrame(services, schema), spark.createDataFrame(pois, schema)).where("matched").collect()
    assert {(r["service_id"], r["poi_id"]) for r in found if r["service_id"] > 9000} == {(9001, 300_001), (9002, 300_002)}
