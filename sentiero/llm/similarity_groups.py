"""Groups of mutually similar records: neighbour descent, modularity communities, exact agreement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kdtree import Splits
from ..runtime import stage

#: Rows of the sample that places the planes of the random-projection trees; every row is then placed and searched.
SAMPLE_ROWS = 20_000
#: Records of a community that one task compares with as many others.
PAIR_BLOCK = 2_000


class Feature(NamedTuple):
    """How one attribute is compared: share and units that two values may differ by, the least possible value, and
    factors of a wrong unit."""

    name: str
    share: float = 0.12
    units: float = 0.0
    least: float = 0.0
    factors: tuple[float, ...] = ()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def gaps(a: np.ndarray, b: np.ndarray, features: Sequence[Feature]) -> np.ndarray:
    """Differences of rows of ``a`` and ``b`` in units of what is allowed: up to 1 agrees, NaN where one is missing.

    A value that is another's multiple by a factor of a wrong unit counts as missing.
    """
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.array([f.share for f in features])
        units = np.array([f.units for f in features])
        high, low = np.maximum(np.abs(a), np.abs(b)), np.minimum(np.abs(a), np.abs(b))
        out = np.abs(a - b) / np.maximum(np.maximum(share * high, units), 1e-9)
        for k, f in enumerate(features):
            for factor in f.factors:
                odd = np.abs(high[..., k] / np.maximum(low[..., k], 1e-9) / factor - 1) <= f.share
                out[..., k] = np.where(odd & (out[..., k] > 1), np.nan, out[..., k])
    return out


def distance(a: np.ndarray, b: np.ndarray, features: Sequence[Feature]) -> np.ndarray:
    """Mean gap over the attributes that both have, each counted as 4 at most, so that one bad value can't part rows."""
    g = np.minimum(gaps(a, b, features), 4.0)
    there = ~np.isnan(g)
    return np.where(there.any(axis=-1), np.nansum(g, axis=-1) / np.maximum(there.sum(axis=-1), 1), 4.0)


def agree(a: np.ndarray, b: np.ndarray, features: Sequence[Feature], least_shared: int) -> np.ndarray:
    """Whether all attributes that both have agree, and enough of them are there."""
    g = gaps(a, b, features)
    return np.nan_to_num(np.nanmax(np.where(np.isnan(g), -1.0, g), axis=-1), nan=9.0).__le__(1.0) & ((~np.isnan(g)).sum(axis=-1) >= least_shared)


def clean(df: DataFrame, key: str, features: Sequence[Feature]) -> DataFrame:
    """(id, v): attribute arrays with impossible values as null; repeated rows of a key once (the greatest content)."""
    value = [F.when(F.nanvl(F.col(f"`{f.name}`").cast("double"), F.lit(None).cast("double")) >= f.least, F.col(f"`{f.name}`").cast("double")) for f in features]
    return df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("bigint").alias("id")).agg(F.max(F.array(*value)).alias("v"))


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """(id, other, d): the ``k`` nearest of each id among pairs (id, other, d), repeated ones once.

    A limit within each task comes before the shuffle, so a row that is near to very many is never gathered whole.
    """
    distinct = pairs.groupBy("id", "other").agg(F.min("d").alias("d"))
    by = Window.partitionBy("id").orderBy("d", "other")
    return distinct.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).drop("r")


def neighbour_descent(points: DataFrame, features: Sequence[Feature], k: int = 12, trees: int = 4, leaf: int = 96, rounds: int = 2, seed: int = 5) -> DataFrame:
    """Approximate nearest neighbours (id, other, d) of ``points`` (id, v).

    Random-projection trees give each point its first neighbours; each round joins the neighbours of every point, both
    ways, with each other and keeps the ``k`` nearest. Tree planes come from a bounded sample; all points are placed, and
    where the table is so large that a leaf of the sample's tree holds more than ``leaf`` rows, the task that has it cuts
    it further, so leaves have one size whatever the number of rows. A round only hands on pairs nearer than the k-th
    neighbour a point has already.
    """
    spark = points.sparkSession
    n = points.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    sample = points.sample(share, seed=seed).limit(2 * SAMPLE_ROWS) if share < 1 else points
    base = _matrix(sample.select("v").toPandas()["v"]).reshape(-1, len(features))
    middle = np.nan_to_num(np.nanmedian(base, axis=0)) if len(base) else np.zeros(len(features))
    flat = lambda m: np.log(np.maximum(np.where(np.isnan(m), middle, m), 0) + 2.0)
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        chosen = rng.permutation(len(features))[: max(2, len(features) // 2)]
        axes = np.zeros((len(features), 4))
        axes[chosen] = rng.normal(size=(len(chosen), 4))
        forest.append((axes, Splits(flat(base) @ axes, max(1, int(leaf * share)))))
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = flat(_matrix(b["v"]))
            for t, (axes, splits) in enumerate(shared.value):
                row, at = splits.reach(x @ axes, 0.0)
                yield pd.DataFrame({"tree": t, "leaf": at, "id": b["id"].to_numpy()[row], "v": b["v"].to_numpy()[row]})

    def nearest(ids: np.ndarray, v: np.ndarray, within: np.ndarray | None = None) -> pd.DataFrame:
        """The k nearest of each row within one set, in blocks; only those nearer than ``within`` of the row."""
        out_i, out_o, out_d = [], [], []
        step = max(1, 200_000 // max(len(ids), 1))
        for i in range(0, len(ids), step):
            d = distance(v[i : i + step, None, :], v[None, :, :], features)
            d[np.arange(d.shape[0]), np.arange(i, i + d.shape[0])] = np.inf
            kk = min(k, len(ids) - 1)
            if kk < 1:
                continue
            by = np.argpartition(d, kk - 1, axis=1)[:, :kk]
            far = np.take_along_axis(d, by, 1)
            keep = far < (np.inf if within is None else within[i : i + step, None])
            out_i.append(np.repeat(ids[i : i + step], kk)[keep.ravel()])
            out_o.append(ids[by][keep])
            out_d.append(far[keep])
        if not out_i:
            return pd.DataFrame({"id": np.empty(0, np.int64), "other": np.empty(0, np.int64), "d": np.empty(0)})
        return pd.DataFrame({"id": np.concatenate(out_i), "other": np.concatenate(out_o), "d": np.concatenate(out_d)})

    kind = "id bigint, other bigint, d double"
    placed = points.mapInPandas(place, "tree int, leaf int, id bigint, v array<double>")

    def in_leaf(g: pd.DataFrame) -> pd.DataFrame:
        ids, v = g["id"].to_numpy(), _matrix(g["v"])
        if len(ids) <= 2 * leaf:
            return nearest(ids, v)
        x = flat(v) @ shared.value[int(g["tree"].iloc[0])][0]
        row, at = Splits(x, leaf).reach(x, 0.0)
        row = row[np.argsort(at, kind="stable")]
        cuts = np.cumsum(np.bincount(at))[:-1]
        return pd.concat([nearest(ids[r], v[r]) for r in np.split(row, cuts) if len(r)])

    first = placed.groupBy("tree", "leaf").applyInPandas(in_leaf, kind)
    graph = stage(_top(first, k))

    def local_join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [nearest(np.array(m, dtype=np.int64), np.array(v, dtype=float).reshape(len(m), -1), np.array(w, dtype=float)) for m, v, w in zip(b["members"], b["vectors"], b["within"], strict=True)]
            if found:
                yield pd.concat(found)

    for _ in range(rounds):
        both = graph.unionByName(graph.select(F.col("other").alias("id"), F.col("id").alias("other"), "d"))
        members = _top(both, 2 * k).select("id", F.col("other").alias("member")).unionByName(points.select("id", F.col("id").alias("member")))
        # A point with k neighbours wants nearer ones only; single precision will do to find them.
        worst = graph.groupBy(F.col("id").alias("member")).agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).cast("float").alias("within"))
        known = points.select(F.col("id").alias("member"), F.transform("v", lambda x: x.cast("float")).alias("v")).join(worst, "member", "left").withColumn("within", F.coalesce("within", F.lit(float("inf")).cast("float")))
        lists = members.join(known, "member").groupBy("id").agg(F.collect_list(F.struct("member", "v", "within")).alias("m")).select(F.col("m.member").alias("members"), F.flatten("m.v").alias("vectors"), F.col("m.within").alias("within"))
        graph = stage(_top(graph.unionByName(lists.mapInPandas(local_join, kind)), k))
    return graph


def communities(edges: DataFrame, levels: int = 4, rounds: int = 6) -> DataFrame:
    """(id, community) by modularity: local moves and aggregation over weighted edges (a, b, w), each edge one way.

    In a round half of the vertices, drawn by a hash of vertex and round, go to the neighbouring community with the
    greatest gain; when nothing moves, communities become vertices. State is written to the shared folder each round.
    """
    both = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w")).where(F.col("a") != F.col("b"))
    links = stage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    twice_m = links.agg(F.sum("w")).first()[0] or 1.0
    degrees = links.groupBy("a").agg(F.sum("w").alias("k"))
    member = degrees.select(F.col("a").alias("id"), F.col("a").alias("community"))
    nodes = stage(degrees.select(F.col("a").alias("id"), "k", F.col("a").alias("c")))
    for level in range(levels):
        any_move = False
        for r in range(rounds):
            near = links.join(nodes.select(F.col("id").alias("b"), "c"), "b").where(F.col("a") != F.col("b")).groupBy("a", "c").agg(F.sum("w").alias("w"))
            total = nodes.groupBy("c").agg(F.sum("k").alias("tot"))
            own = nodes.select(F.col("id").alias("a"), "k", F.col("c").alias("own"))
            options = near.unionByName(nodes.select(F.col("id").alias("a"), "c", F.lit(0.0).alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w")).join(own, "a").join(total, "c")
            gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / twice_m
            best = options.withColumn("gain", gain).groupBy("a").agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("best"), F.max("gain").alias("gain"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"), F.first("k").alias("k"), F.first("own").alias("own"))
            turn = F.pmod(F.xxhash64("a", F.lit(level * rounds + r)), F.lit(2)) == 0
            moved = best.select(F.col("a").alias("id"), "k", F.when(turn & (F.col("gain") > F.col("stay") + 1e-9), F.col("best")).otherwise(F.col("own")).alias("c"), ((F.col("gain") > F.col("stay") + 1e-9) & (F.col("best") != F.col("own"))).alias("wants"))
            moved = stage(moved)
            wants = moved.agg(F.count_if("wants")).first()[0] or 0
            nodes = moved.select("id", "k", "c")
            any_move = any_move or wants > 0
            if not wants:
                break
        member = stage(member.join(nodes.select(F.col("id").alias("community"), "c"), "community").select("id", F.col("c").alias("community")))
        if not any_move:
            break
        ca, cb = nodes.select(F.col("id").alias("a"), F.col("c").alias("ca")), nodes.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        links = stage(links.join(ca, "a").join(cb, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        nodes = stage(nodes.groupBy("c").agg(F.sum("k").alias("k")).select(F.col("c").alias("id"), "k", "c"))
    return member


class Groups(NamedTuple):
    members: DataFrame
    """(id, community, degree): every record of a community with its internal weighted degree."""
    pairs: DataFrame
    """(a, b), a < b: records of one community that agree exactly."""


def similarity_groups(df: DataFrame, key: str, features: Sequence[Feature], least_shared: int | None = None, k: int = 12) -> Groups:
    """Communities of records of ``df`` whose attributes all agree within their tolerance.

    Impossible values are missing; missing and wrong-unit values are left aside; at least ``least_shared`` attributes
    (default two thirds) must be there on both sides. Records with the same values are one point of the graph and come
    apart again at the end. Edges of the neighbour graph are those that agree exactly; a community's most typical
    members are those of the greatest internal weighted degree. Records without neighbours or with fewer attributes are in no community. Null
    keys are left out; repeated rows count once; an empty table gives empty results; other columns are not read.
    """
    shared_least = least_shared if least_shared is not None else -(-2 * len(features) // 3)
    # A record with fewer attributes can agree with none, so it takes no part.
    rows = stage(clean(df, key, features).where(F.size(F.filter("v", lambda x: x.isNotNull())) >= shared_least))
    points = stage(rows.groupBy("v").agg(F.min("id").alias("id"), F.collect_list("id").alias("ids")))
    graph = neighbour_descent(points.select("id", "v"), features, k)
    one_way = graph.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "d").distinct()
    at = points.select("id", "v")
    with_v = one_way.join(at.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(at.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ok = agree(_matrix(b["va"]), _matrix(b["vb"]), features, shared_least)
                yield b.loc[ok, [c for c in b.columns if c not in ("va", "vb")]]

    edges = stage(with_v.mapInPandas(check, "a bigint, b bigint, d double").withColumn("w", 1 / (1 + F.col("d"))))
    of_point = communities(edges.select("a", "b", "w"))
    degree = edges.join(of_point.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(of_point.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb")
    degree = degree.select("a", "w").unionByName(degree.select(F.col("b").alias("a"), "w")).groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("degree"))
    of_point = of_point.join(degree, "id", "left")
    copies = points.join(of_point, "id", "left").where(F.col("community").isNotNull() | (F.size("ids") > 1))
    members = stage(copies.select(F.explode("ids").alias("id"), F.coalesce("community", "id").alias("community"), (F.coalesce("degree", F.lit(0.0)) + F.size("ids") - 1).alias("degree"), "v"))
    # A large community is cut into blocks that meet each other in tasks of their own.
    blocks = members.groupBy("community").agg(F.ceil(F.count("*") / F.lit(PAIR_BLOCK)).cast("int").alias("blocks"))
    cut = members.join(blocks, "community").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = cut.select("community", F.col("id").alias("a"), F.col("v").alias("va"), F.col("block").alias("x"), other.alias("y"))
    right = cut.select("community", F.col("id").alias("b"), F.col("v").alias("vb"), F.col("block").alias("y"), other.alias("x"))
    near = left.join(right, ["community", "x", "y"]).where(F.col("a") < F.col("b")).select("a", "b", "va", "vb")
    return Groups(members.select("id", "community", "degree"), near.mapInPandas(check, "a bigint, b bigint"))


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """(community, members, typical): size and the most typical members of each community, greatest degree first."""
    by = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    top = members.withColumn("r", F.row_number().over(by))
    return top.groupBy("community").agg(F.count("*").alias("members"), F.array_sort(F.collect_list(F.when(F.col("r") <= typical, F.struct("r", "id")))).alias("t")).select("community", "members", F.col("t.id").alias("typical"))
