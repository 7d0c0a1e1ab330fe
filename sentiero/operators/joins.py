"""Joins with guarantees: one-to-one, first match, and choice of columns by candidate names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import join_key


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def resolve_column(columns: Iterable[str], candidates: Sequence[str], required: bool = False, explicit: str | None = None, normalise: Callable[[str], str] = snake) -> str | None:
    """The first column whose normalised name is among the candidates, in their order; ``explicit`` must be there."""
    names = list(columns)
    if explicit is not None:
        if explicit not in names:
            raise ValueError(f"no column {explicit!r} among {names}")
        return explicit
    by = {}
    for n in names:
        by.setdefault(normalise(n), n)
    for c in candidates:
        if normalise(c) in by:
            return by[normalise(c)]
    if required:
        raise ValueError(f"none of {list(candidates)} among {names}")
    return None


def matching_columns(columns: Iterable[str], pattern: str) -> list[str]:
    """The columns whose name a pattern finds, in their order."""
    return [c for c in columns if re.search(pattern, c)]


def shared_columns(*dfs: DataFrame) -> list[str]:
    """Columns that all tables have, in the order of the first."""
    return [c for c in dfs[0].columns if all(c in d.columns for d in dfs[1:])]


def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    """All columns but the key with a prefix."""
    return df.select(key, *[F.col(f"`{c}`").alias(prefix + c) for c in df.columns if c != key])


def join_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that raises if a key repeats on either side."""
    for side, df in (("left", left), ("right", right)):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{side} side repeats a value of {key}")
    return left.join(right, key, "left")


def join_first(left: DataFrame, right: DataFrame, key: str, order: str, suffixes: tuple[str, str] = ("_geo", "_istat"), flag: str = "trovato") -> DataFrame:
    """Left join to the first right row of each normalised key; clashing names get suffixes, ``flag`` tells matches."""
    # The first row by partial aggregation: a key that is very frequent isn't sorted in one task.
    first = right.groupBy(join_key(F.col(key)).alias("__key")).agg(F.min_by(F.struct(*right.columns), order).alias("__row")).where(F.col("__key").isNotNull()).select("__key", "__row.*")
    clash = set(left.columns) & set(right.columns)
    mine = left.select(join_key(F.col(key)).alias("__key"), *[F.col(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns])
    theirs = first.select("__key", *[F.col(c).alias(c + suffixes[1] if c in clash else c) for c in right.columns], F.lit(True).alias(flag))
    return mine.join(theirs, "__key", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).withColumnRenamed("__key", "chiave")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows whose normalised key the right side hasn't."""
    return left.withColumn("__key", join_key(F.col(key))).join(right.select(join_key(F.col(key)).alias("__key")), "__key", "left_anti").drop("__key")
