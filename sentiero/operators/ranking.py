"""Ranks, scores and scales over groups, and top rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clip


def running_total(df: DataFrame, value: str, n: str, out: str, by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """``df`` with ``out``: sum of ``n`` up to and with each value within ``by``; values must be distinct and not null.

    Values fall into range buckets at approximate quantiles, so no task sorts a whole group: sums of the buckets give
    the offsets, a window inside a bucket the rest. The boundaries only balance the work.
    """
    keys = list(by)
    cuts = df.agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 2000)).alias("__cuts"))
    at = df.join(F.broadcast(cuts)).withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    sums = at.groupBy(*keys, "__b").agg(F.sum(n).alias("__t"))
    offset = F.coalesce(F.sum("__t").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*keys, "__b", offset.alias("__before"))
    inside = F.sum(n).over(Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return at.join(offsets, [*keys, "__b"]).withColumn(out, F.col("__before") + inside).drop("__b", "__before")


def percentile_score(df: DataFrame, value: str, out: str, by: Sequence[str] = (), higher_is_better: bool = True, constant: float | None = 50.0) -> DataFrame:
    """``df`` with ``out``: average rank of ``value`` among the non-null ones, in percent, or 100 minus it.

    Ties share their mean rank. With at most one distinct value all get ``constant`` (None: no such rule); nulls get 50.
    The counts of distinct values are summed up before they're ranked, by range buckets.
    """
    keys = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.count("*").alias("__kinds"))
    ranked = running_total(counts, value, "__n", "__upto", keys)
    ranked = ranked.join(totals, keys) if keys else ranked.join(F.broadcast(totals))
    pct = 100.0 * (F.col("__upto") - (F.col("__n") - 1) / 2) / F.col("__all")
    score = pct if higher_is_better else 100.0 - pct
    if constant is not None:
        score = F.when(F.col("__kinds") <= 1, F.lit(constant)).otherwise(score)
    ranked = ranked.select(*keys, value, score.alias("__s"))
    return df.join(ranked, [*keys, value], "left").withColumn(out, F.coalesce("__s", F.lit(50.0))).select(*df.columns, out)


def percentile_scores(df: DataFrame, key: str, columns: Sequence[str], constant: float = 50.0) -> DataFrame:
    """(key, one score per column): ``percentile_score`` of many columns of rows with a unique key in one pass.

    Rows are unpivoted, so all columns share one count, one ranking and one join, and the plan doesn't grow with them.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("__c"), F.col(c).cast("double").alias("__v")) for c in columns])
    long = df.select(key, F.explode(entries).alias("e")).select(key, "e.*")
    counts = long.where(F.col("__v").isNotNull()).groupBy("__c", "__v").agg(F.count("*").alias("__n"))
    totals = counts.groupBy("__c").agg(F.sum("__n").alias("__all"), F.count("*").alias("__kinds"))
    ranked = running_total(counts, "__v", "__n", "__upto", ["__c"]).join(totals, "__c")
    score = F.when(F.col("__kinds") <= 1, F.lit(constant)).otherwise(100.0 * (F.col("__upto") - (F.col("__n") - 1) / 2) / F.col("__all"))
    at = long.join(ranked.select("__c", "__v", score.alias("__s")), ["__c", "__v"], "left")
    return at.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("__c") == c, F.col("__s"))), F.lit(constant)).alias(c) for c in columns])


def exact_quantiles(df: DataFrame, values: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """One row with, for each of ``values``, the array of its exact quantiles at ``shares``, interpolated linearly.

    Ranks come from counts of the distinct values by range buckets, so neither a task nor a buffer holds a whole column;
    null and NaN don't count, and a column without values has an array of nulls.
    """
    entries = F.array(*[F.struct(F.lit(v).alias("__c"), F.col(v).cast("double").alias("__v")) for v in values])
    counts = df.select(F.explode(entries).alias("e")).select("e.*").where(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy("__c", "__v").agg(F.count("*").alias("__n"))
    counts = running_total(counts, "__v", "__n", "__upto", ["__c"])
    wanted = counts.groupBy("__c").agg(F.sum("__n").alias("__all")).select("__c", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("__i", "__s"), "__all").withColumn("__at", F.col("__s") * (F.col("__all") - 1))
    # The values at the places below and above each quantile; one row for each column and share.
    hit = counts.join(F.broadcast(wanted), "__c").where((F.ceil("__at") >= F.col("__upto") - F.col("__n")) & (F.floor("__at") < F.col("__upto")))
    low = F.max(F.when(F.floor("__at") >= F.col("__upto") - F.col("__n"), F.col("__v")))
    high = F.max(F.when(F.ceil("__at") < F.col("__upto"), F.col("__v")))
    found = hit.groupBy("__c", "__i", "__at").agg(low.alias("__lo"), high.alias("__hi"))
    found = found.withColumn("__q", F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__at") - F.floor("__at")))
    return found.agg(*[F.array(*[F.max(F.when((F.col("__c") == v) & (F.col("__i") == i), F.col("__q"))) for i in range(len(shares))]).alias(v) for v in values])


def _beside(df: DataFrame, quantiles: DataFrame) -> DataFrame:
    """``df`` with the one row of ``quantiles`` as columns __name."""
    return df.join(F.broadcast(quantiles.select(*[F.col(c).alias(f"__{c}") for c in quantiles.columns])))


def rank_quartile(pct: Column) -> Column:
    """Quartile class of a rank percentage: (0, 25], (25, 50], (50, 75], (75, 100]."""
    return F.when(pct <= 25, "Q1").when(pct <= 50, "Q2").when(pct <= 75, "Q3").when(pct <= 100, "Q4")


def robust_z(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: 0.67448975 (x - median) / MAD, by the sample deviation if MAD is 0, 0 if both are 0."""
    centre = exact_quantiles(df, [value], (0.5,)).select(F.col(value)[0].alias("__m")).join(F.broadcast(df.agg(F.stddev_samp(value).alias("__s"))))
    spread = exact_quantiles(df.join(F.broadcast(centre)).select(F.abs(F.col(value) - F.col("__m")).alias("d")), ["d"], (0.5,)).select(F.col("d")[0].alias("__mad"))
    # Both sides are one row.
    at = df.join(F.broadcast(centre)).join(F.broadcast(spread))
    z = F.when(F.col("__mad") > 0, 0.67448975 * (F.col(value) - F.col("__m")) / F.col("__mad")).when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return at.withColumn(out, F.when(F.col(value).isNotNull(), z)).select(*df.columns, out)


def winsorize(df: DataFrame, values: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``values`` held within their exact quantiles; one aggregation, joined back as one row."""
    at = _beside(df, exact_quantiles(df, values, (low, high)))
    bounded = {v: F.when(F.col(v).isNotNull(), F.greatest(F.least(F.col(v), F.col(f"__{v}")[1]), F.col(f"__{v}")[0])) for v in values}
    return at.withColumns(bounded).select(*df.columns)


def log_scale(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """log1p of the values, negatives as 0."""
    return df.withColumns({v: F.log1p(clip(F.col(v).cast("double"), 0.0, None)) for v in values})


def impute_median(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Nulls replaced by the exact median; 0 for an all-null column."""
    at = _beside(df, exact_quantiles(df, values, (0.5,)))
    return at.withColumns({v: F.coalesce(v, F.col(f"__{v}")[0], F.lit(0.0)) for v in values}).select(*df.columns)


def robust_scale(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range, by exact quantiles; a range of 0 counts as 1."""
    at = _beside(df, exact_quantiles(df, values, (0.25, 0.5, 0.75)))
    scaled = {v: (F.col(v) - F.col(f"__{v}")[1]) / F.coalesce(F.nullif(F.col(f"__{v}")[2] - F.col(f"__{v}")[0], F.lit(0.0)), F.lit(1.0)) for v in values}
    return at.withColumns(scaled).select(*df.columns)


def quantile_breaks(df: DataFrame, value: str, classes: int) -> DataFrame:
    """(classe, soglia): nearest-rank breaks of the sorted values at round((n-1) i / classes), doubles kept once.

    Ranks come from the counts of distinct values by range buckets, so rows aren't sorted one by one.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    at = running_total(counts, value, "n", "upto")
    total = df.agg(F.count(value).alias("all"))
    wanted = total.select(F.explode(F.sequence(F.lit(0), F.lit(classes))).alias("i"), "all").withColumn("rank", F.floor((F.col("all") - 1) * F.col("i") / F.lit(classes) + 0.5))
    hit = at.join(F.broadcast(wanted), (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return hit.groupBy(F.col(value).alias("soglia")).agg(F.min("i").cast("int").alias("classe")).select("classe", "soglia")


def numbered_names(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """``df`` with ``out``: the name, with _2, _3 ... for its repeats in ``order``."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("__n", n).withColumn(out, F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat_ws("_", name, F.col("__n").cast("string")))).drop("__n")


def surrogate_ids(df: DataFrame, order: str, out: str, prefix: str = "", digits: int = 0) -> DataFrame:
    """``df`` with ``out``: 1..n in the order of the unique, not null column ``order``, as text after a prefix if given.

    Places come from counts by range buckets, so no task numbers the whole table.
    """
    placed = running_total(df.select(order).withColumn("__n", F.lit(1)), order, "__n", "__place")
    place = F.col("__place")
    named = F.concat(F.lit(prefix), F.lpad(place.cast("string"), F.greatest(F.lit(digits), F.length(place.cast("string"))), F.lit("0"))) if prefix or digits else place
    return df.join(placed.select(order, named.alias(out)), order)


def top_per_key(df: DataFrame, key: Sequence[str], score: str, tie: Column, k: int) -> DataFrame:
    """The ``k`` best rows of each key with rank and gap to the next score (0 counts as the score after the last).

    The k + 1 best are taken first, by a limit that is applied before the shuffle too; the gap is seen among those.
    """
    w = Window.partitionBy(*key).orderBy(F.desc(score), tie)
    best = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    by_rank = Window.partitionBy(*key).orderBy("rank")
    return best.withColumn("gap", F.col(score) - F.lead(score, 1, 0.0).over(by_rank)).where(F.col("rank") <= k)


def deduplicate(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row in ``order`` of each key combination, nulls alike, by partial aggregation."""
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")
