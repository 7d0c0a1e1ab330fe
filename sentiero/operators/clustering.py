"""Profiles of few groups: Ward's hierarchy, silhouette, k-means with restarts, and names by rank."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage

#: Rows that the hierarchy, whose pairs are all compared, takes at most; more raise.
WARD_ROWS = 5_000


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k (by first member) of Ward's agglomeration of the rows of ``x``."""
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    size, member = np.ones(n), [[i] for i in range(n)]
    alive = np.ones(n, bool)
    for _ in range(n - k):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        ni, nj, nk = size[i], size[j], size
        # Lance-Williams update of squared distances for minimum variance.
        new = ((ni + nk) * d[i] + (nj + nk) * d[j] - nk * d[i, j]) / (ni + nj + nk)
        new[~alive] = np.inf
        new[[i, j]] = np.inf
        d[i, :] = d[:, i] = new
        d[j, :] = d[:, j] = np.inf
        alive[j] = False
        size[i] += size[j]
        member[i] += member[j]
    label = np.zeros(n, int)
    for c, group in enumerate(sorted((m for m, a in zip(member, alive, strict=True) if a), key=min), 1):
        label[group] = c
    return label


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette with Euclidean distances; rows alone in their group count 0."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    names = np.unique(label)
    if len(names) < 2:
        return 0.0
    mean = np.column_stack([d[:, label == c].sum(axis=1) for c in names])
    count = np.array([(label == c).sum() for c in names])
    own = np.searchsorted(names, label)
    at = np.arange(len(x))
    a = mean[at, own] / np.maximum(count[own] - 1, 1)
    other = mean / count
    other[at, own] = np.inf
    b = other.min(axis=1)
    return float(np.where(count[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).mean())


def ward_groups(df: DataFrame, key: str, features: Sequence[str], k: int) -> DataFrame:
    """(key, cluster, silhouette) of at most ``WARD_ROWS`` rows, prepared by the caller; more rows raise."""
    if df.limit(WARD_ROWS + 1).count() > WARD_ROWS:
        raise ValueError(f"Ward's hierarchy compares all pairs; it takes {WARD_ROWS} rows at most")
    kind = df.schema[key].dataType.simpleString()

    def group(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key, kind="stable")
        x = g[list(features)].to_numpy(float)
        label = ward_labels(x, min(k, len(x)))
        return pd.DataFrame({key: g[key].to_numpy(), "cluster": label, "silhouette": silhouette(x, label)})

    return df.select(key, *features).groupBy(F.lit(1).alias("all")).applyInPandas(lambda g: group(g), f"{key} {kind}, cluster int, silhouette double")


def kmeans_groups(df: DataFrame, key: str, features: Sequence[str], k: int, starts: int = 30, seed: int = 42) -> DataFrame:
    """(key, cluster): k-means on standardised features, the cheapest of several starts; distributed."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="__raw").transform(df)
    scaled = stage(StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(vectors).transform(vectors).select(key, "features"))
    models = [KMeans(k=k, seed=seed + i, initSteps=2).fit(scaled) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(scaled).select(key, F.col("prediction").cast("int").alias("cluster"))


def profiles(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """(cluster, n, mean of each feature)."""
    return df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])
