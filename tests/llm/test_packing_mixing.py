from collections import Counter, defaultdict

import numpy as np
import pytest

from sentiero.llm.mixing import mix, mix_report
from sentiero.llm.packing import configurations, pack, packing_report
from sentiero.llm.tokens import token_counts

KINDS = {"corto": 100, "lungo": 1000}


def _pack(spark, items):
    df = spark.createDataFrame(items, "id bigint, tokens bigint")
    return pack(df, spark.createDataFrame(list(KINDS.items()), "container_kind string, capacity_tokens int"))


def test_pack_holds_every_item_once(spark):
    rng = np.random.default_rng(8)
    items = [(i, int(n)) for i, n in enumerate(np.exp(rng.normal(4, 1, 3000)))] + [(5000, 1000), (5001, 2000), (5002, 2001), (5003, 0), (5004, None), (None, 7), (0, 1)]
    out = _pack(spark, items).collect()
    best = defaultdict(int)
    for i, n in items:
        if i is not None and n:
            best[i] = max(best[i], n)
    for kind, c in KINDS.items():
        own = [r for r in out if r["container_kind"] == kind]
        total, pieces, used = Counter(), defaultdict(list), Counter()
        for r in own:
            total[r["id"]] += r["tokens"]
            pieces[r["id"]].append(r["tokens"])
            used[r["container"]] += r["tokens"]
        assert total == Counter({i: n for i, n in best.items() if n})
        assert all(len(p) == 1 for i, p in pieces.items() if best[i] <= c)
        assert all(sorted(p)[1:] == [c] * (len(p) - 1) for p in pieces.values() if len(p) > 1)
        assert all(u <= c for u in used.values())
        assert {r["container"]: r["unused"] for r in own} == {k: c - u for k, u in used.items()}
        assert len(used) <= 1.03 * -(-sum(best.values()) // c) + 2


def test_pack_edges(spark):
    assert _pack(spark, []).count() == 0
    same = _pack(spark, [(i, 50) for i in range(1000)])
    report = {r["container_kind"]: r for r in packing_report(same).collect()}
    assert report["corto"]["containers"] == 500 and report["lungo"]["containers"] == 50
    assert report["corto"]["unused"] == 0


def test_configurations_cover_demand():
    sizes, demand = np.array([60, 45, 33, 21]), np.array([10, 20, 30, 40])
    plan = configurations(sizes, demand, 100)
    held = sum(p * t for p, t in plan)
    assert (held >= demand).all() and all(p @ sizes <= 100 for p, _ in plan)
    assert sum(t for _, t in plan) <= np.ceil(demand @ sizes / 100) + 5


def test_mix_shares_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[i % 3 if i % 10 else 0], int(n)) for i, n in enumerate(rng.integers(1, 50, 6000))]
    sizes = spark.createDataFrame([*rows, rows[0], (None, "a", 5), (90_000, None, 5), (90_001, "untargeted", 5), (90_002, "a", None)], "id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("gone", 0.0, 1)], "source string, target_weight double, max_repeats int")
    out = mix(sizes, targets, bucket_rows=300).collect()
    assert [r["finish"] for r in out] == sorted(r["finish"] for r in out)
    assert len({(r["id"], r["pass"]) for r in out}) == len(out)
    total = sum(r["tokens"] for r in out)
    share = Counter()
    for r in out:
        share[r["source"]] += r["tokens"] / total
    assert all(abs(share[s] - w) < 0.01 for s, w in (("a", 0.6), ("b", 0.3), ("c", 0.1)))
    assert all(r["pass"] <= {"a": 1, "b": 2, "c": 3}[r["source"]] for r in out)
    wide = mix(sizes, targets, total_tokens=10**9)
    report = {r["source"]: r for r in mix_report(wide, targets).collect()}
    assert {s: report[s]["repeats"] for s in "abc"} == {"a": 1, "b": 2, "c": 3} and report["gone"]["tokens"] == 0
    assert mix(sizes.limit(0), targets).count() == 0


def test_token_counts(spark):
    from pathlib import Path

    from sentiero.llm.tokens import VOCABULARY, encoding

    if not Path(VOCABULARY).exists():
        pytest.skip("no tokenizer here")
    texts = ["", "hello world", "x" * 200_000, None, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "a", 1)], "k bigint, text string, id bigint")
    got = {r["id"]: r["tokens"] for r in token_counts(df, "k", "text").collect()}
    assert got == {i: len(encoding().encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
