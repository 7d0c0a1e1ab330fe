"""Filling fixed-capacity containers: linear grouping, configurations of few sizes, best-fit of the small items."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage, width

#: Items above this share of the capacity are grouped and laid out by configurations, the others are best-fitted.
LARGE_SHARE = 1 / 8
#: Groups of equal cardinality whose items are rounded up to the largest of the group.
GROUPS = 24
#: Units of the capacity in which the configurations are optimised; sizes are rounded up to them.
GRID = 1024
#: Small items and open containers that one task fits together.
SHARD = 40_000


class Layout(NamedTuple):
    """Where the large items of one capacity go: by length the group and rank offset, by group the runs of slots."""

    first_rank: dict[int, tuple[int, int]]
    """length: (group, rank in the group of the first item of that length)"""
    runs: list[list[tuple[int, int, int]]]
    """by group: (rank of the run's first slot, first container, slots of the group in each of the run's containers)"""
    containers: int


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, grid: int) -> np.ndarray:
    """Counts of sizes that fit into ``grid`` with the greatest total price (unbounded knapsack)."""
    best = np.zeros(grid + 1)
    took = np.full(grid + 1, -1)
    for room in range(int(sizes.min()), grid + 1):
        fits = np.nonzero(sizes <= room)[0]
        value = best[room - sizes[fits]] + prices[fits]
        k = int(value.argmax())
        if value[k] > best[room - 1] + 1e-12:
            best[room], took[room] = value[k], fits[k]
        else:
            best[room] = best[room - 1]
    out, room = np.zeros(len(sizes)), grid
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            out[took[room]] += 1
            room -= sizes[took[room]]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, grid: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(counts by size, containers) that hold ``demand`` items of ``sizes`` (in grid units) in nearly the fewest containers.

    Column generation over configurations; the fractional optimum is rounded down and the rest laid out first-fit.
    """
    k = len(sizes)
    basis = np.diag(np.maximum(grid // sizes, 1).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        column = _best_pattern(np.maximum(prices, 0), sizes, grid)
        if prices @ column <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-10, x / np.maximum(step, 1e-10), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        x = np.maximum(x - ratio[leaves] * step, 0)
        x[leaves] = ratio[leaves]
        basis[:, leaves] = column
    left = demand.astype(int).copy()
    out = []
    for j in range(k):
        times = int(np.floor(x[j] + 1e-9))
        pattern = basis[:, j].astype(int)
        while times and ((pattern * times > left) & (pattern > 0)).any():
            times -= 1
        if times:
            out.append((pattern, times))
            left -= pattern * times
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        pattern, room = np.zeros(k, int), grid
        for i in order:
            n = int(min(left[i], room // sizes[i]))
            pattern[i] += n
            room -= n * int(sizes[i])
        times = max(1, int(min(left[i] // pattern[i] for i in range(k) if pattern[i])))
        out.append((pattern, times))
        left -= pattern * times
    return out


def plan_layout(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Layout:
    """Layout of large items given as a histogram; its size depends on the capacity and the groups only."""
    by = np.argsort(-lengths)
    lengths, counts = lengths[by].astype(int), counts[by].astype(int)
    total = int(counts.sum())
    if not total:
        return Layout({}, [], 0)
    groups = min(GROUPS, len(lengths))
    before = np.concatenate(([0], np.cumsum(counts)[:-1]))
    group = np.minimum(before * groups // total, groups - 1)
    _, group = np.unique(group, return_inverse=True)
    groups = int(group.max()) + 1
    top = np.array([lengths[group == g].max() for g in range(groups)])
    demand = np.array([counts[group == g].sum() for g in range(groups)])
    start = np.array([before[group == g].min() for g in range(groups)])
    sizes = np.minimum(np.ceil(top * GRID / capacity).astype(int), GRID)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(groups)]
    filled, container = np.zeros(groups, int), 0
    for pattern, times in configurations(sizes, demand, GRID):
        for g in np.nonzero(pattern)[0]:
            runs[g].append((int(filled[g]), container, int(pattern[g])))
            filled[g] += int(pattern[g]) * times
        container += times
    return Layout({int(n): (int(g), int(b - start[g])) for n, g, b in zip(lengths, group, before, strict=True)}, runs, container)


def _place(layouts: dict[str, Layout]):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.empty(len(b), np.int64)
            nth = b["nth"].to_numpy()
            # All items of one length go by one look-up among the runs of their group.
            for (kind, n), rows in b.groupby(["container_kind", "tokens"]).indices.items():
                layout = layouts[kind]
                g, first_rank = layout.first_rank[n]
                starts, containers, per = np.array(layout.runs[g], np.int64).T
                rank = first_rank + nth[rows]
                run = np.searchsorted(starts, rank, side="right") - 1
                at[rows] = containers[run] + (rank - starts[run]) // per[run]
            yield pd.DataFrame({"container_kind": b["container_kind"], "slot": at, "id": b["id"], "piece": b["piece"], "tokens": b["tokens"]})

    return place


def _best_fit(key: tuple, items: pd.DataFrame, bins: pd.DataFrame) -> pd.DataFrame:
    """Container of each small item of a shard: the fullest that still has room; new ones are opened when none has."""
    if not len(items):
        return pd.DataFrame({"container_kind": [], "container": [], "id": [], "piece": [], "tokens": []})
    kind, shard = key
    capacity = int(items["capacity"].iloc[0])
    open_at: dict[int, list[str]] = {}
    mask = 0
    for name, room in zip(bins["container"], bins["room"], strict=True):
        open_at.setdefault(int(room), []).append(name)
        mask |= 1 << int(room)
    order = np.lexsort((items["piece"].to_numpy(), items["id"].to_numpy(), -items["tokens"].to_numpy()))
    sizes, out, opened = items["tokens"].to_numpy()[order], [], 0
    for n in map(int, sizes):
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            names = open_at[room]
            name = names.pop()
            if not names:
                mask &= ~(1 << room)
        else:
            name, room = f"s{shard}-{opened}", capacity
            opened += 1
        out.append(name)
        room -= n
        if not open_at.get(room):
            mask |= 1 << room
        open_at.setdefault(room, []).append(name)
    return pd.DataFrame({"container_kind": kind, "container": out, "id": items["id"].to_numpy()[order], "piece": items["piece"].to_numpy()[order], "tokens": sizes})


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, container, id, piece, tokens, unused): containers of each kind filled with all items.

    ``sizes`` has (id bigint, tokens bigint), ``containers`` (container_kind, capacity_tokens). Items beyond a capacity
    fill containers of their own piece by piece, the last piece is an item like others; no other item is split.
    Large items: lengths are cut into groups of equal cardinality and rounded up in each, configurations of the few
    sizes are optimised on the driver from the length histogram, which has no more entries than tokens in a capacity;
    actual items take the slots by their rank, found without a global sort. Small items are best-fitted into what is
    left, in shards of bounded size; each shard leaves at most one container badly filled. Null ids or sizes and items
    of no tokens take no container; repeated rows of an id count once; equal lengths go by id; empty tables give no rows. A kind given with several capacities has the greatest.
    """
    spark = sizes.sparkSession
    # One plan is made for each kind, so kinds are a table of parameters.
    kinds = {r["container_kind"]: int(r["capacity"]) for r in containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity")).collect()}
    if not kinds:
        return spark.createDataFrame([], "container_kind string, container string, id bigint, piece int, tokens bigint, unused bigint")
    one = stage(sizes.where("id is not null and tokens > 0").groupBy("id").agg(F.max("tokens").alias("tokens")))
    kind_rows = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(kinds.items())])
    each = one.select("id", "tokens", F.explode(kind_rows).alias("k")).select("id", "tokens", "k.*")
    full = each.where(F.col("tokens") >= F.col("capacity")).select("container_kind", "capacity", "id", F.explode(F.sequence(F.lit(1), F.floor(F.col("tokens") / F.col("capacity")).cast("int"))).alias("piece"))
    full = full.select("container_kind", F.concat_ws("-", F.lit("f"), "id", "piece").alias("container"), "id", "piece", F.col("capacity").alias("tokens"))
    rest = each.withColumn("piece", F.when(F.col("tokens") >= F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity")).cast("int") + 1).otherwise(1)).withColumn("tokens", F.col("tokens") % F.col("capacity")).where("tokens > 0")
    rest = stage(rest.select("container_kind", "capacity", "id", F.col("piece").cast("int"), "tokens"))
    is_large = F.col("tokens") > F.floor(F.col("capacity") * LARGE_SHARE)
    histogram = rest.groupBy("container_kind", "tokens").agg(F.count("*").alias("n")).toPandas()
    layouts = {}
    for kind, capacity in kinds.items():
        own = histogram[(histogram["container_kind"] == kind) & (histogram["tokens"] > int(capacity * LARGE_SHARE))]
        layouts[kind] = plan_layout(own["tokens"].to_numpy(), own["n"].to_numpy(), capacity)
    most = int(histogram["n"].max()) if len(histogram) else 0
    salts = max(1, -(-most // 100_000))  # one length may be a third of all items
    large = rest.where(is_large).withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    nth = F.row_number().over(Window.partitionBy("container_kind", "tokens", "salt").orderBy("id", "piece")) - 1
    numbered = large.withColumn("nth", nth)
    if salts > 1:
        per_salt = large.groupBy("container_kind", "tokens", "salt").agg(F.count("*").alias("m"))
        before = F.sum("m").over(Window.partitionBy("container_kind", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
        numbered = numbered.join(per_salt.withColumn("before", F.coalesce(before, F.lit(0))), ["container_kind", "tokens", "salt"]).withColumn("nth", F.col("nth") + F.col("before"))
    shared = spark.sparkContext.broadcast(layouts)
    placed = numbered.select("container_kind", "id", "piece", "tokens", F.col("nth").cast("bigint").alias("nth")).mapInPandas(lambda it: _place(shared.value)(it), "container_kind string, slot bigint, id bigint, piece int, tokens bigint")
    placed = stage(placed.withColumn("container", F.concat_ws("-", F.lit("g"), "slot")).drop("slot"))
    room = placed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("used"))
    capacity_of = F.element_at(F.create_map(*[x for k, c in kinds.items() for x in (F.lit(k), F.lit(c).cast("bigint"))]), F.col("container_kind"))
    bins = room.withColumn("room", capacity_of - F.col("used")).where("room > 0").select("container_kind", "container", "room")
    small = rest.where(~is_large)
    items_of = {kind: int(histogram.loc[(histogram["container_kind"] == kind) & (histogram["tokens"] <= int(c * LARGE_SHARE)), "n"].sum()) for kind, c in kinds.items()}
    shards_of = {kind: width(spark, items_of[kind] + layouts[kind].containers, SHARD, 1) for kind in kinds}
    shards = F.element_at(F.create_map(*[x for k, n in shards_of.items() for x in (F.lit(k), F.lit(n))]), F.col("container_kind"))
    bins = bins.withColumn("shard", F.pmod(F.xxhash64("container"), shards).cast("int"))
    small = small.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), shards).cast("int"))
    fitted = small.groupBy("container_kind", "shard").cogroup(bins.groupBy("container_kind", "shard")).applyInPandas(_best_fit, "container_kind string, container string, id bigint, piece int, tokens bigint")
    everything = placed.select("container_kind", "container", "id", "piece", "tokens").unionByName(fitted)
    by = Window.partitionBy("container_kind", "container")
    # A container holds at most as many items as tokens, so the window's partitions are bounded.
    out = everything.withColumn("unused", capacity_of - F.sum("tokens").over(by))
    return out.unionByName(full.withColumn("unused", F.lit(0).cast("bigint")))


def packing_report(packed: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, unused, unused_share) of the output of ``pack``."""
    each = packed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("t"), F.first("unused").alias("u"))
    return each.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum("u").alias("unused")).withColumn("unused_share", F.col("unused") / (F.col("tokens") + F.col("unused")))
