"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage

#: Documents that one bucket of a source's shuffled order holds about.
BUCKET_ROWS = 50_000
#: Sources up to which the table of their shares goes to every task.
FEW_SOURCES = 10_000


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(source, id, pass, tokens, finish): the mix, ordered by virtual finish time.

    ``sizes`` has (id, source, tokens), ``targets`` (source, target_weight, max_repeats). Each source's documents are
    shuffled anew for each pass by a hash of id and pass; a document's virtual finish time is the source's tokens up to
    and with it, over all passes, divided by the target weight. The documents of least finish time, all sources
    together, up to ``total_tokens`` are the mix: as weights sum to one, total and finish time are the same measure.
    By default the total is the greatest at which every source can hold its weight within its passes; with a greater
    one exhausted sources fall short, which ``mix_report`` shows. Weights are scaled to sum to one over the sources
    that have tokens. Running sums go by hash buckets of bounded size, so no source is sorted in one task.
    Sources without a target, of weight 0 or null, null ids and documents without tokens are left out; repeated rows of
    an id count once; equal hashes go by id; empty tables give no rows.
    """
    one = stage(sizes.where("id is not null and source is not null and tokens > 0").groupBy("id").agg(F.max(F.struct("tokens", "source")).alias("r")).select("id", "r.source", "r.tokens"))
    wanted = targets.where("target_weight > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("passes"))
    held = one.groupBy("source").agg(F.sum("tokens").alias("held"), F.count("*").alias("docs")).join(wanted, "source")
    of = held.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1))))
    total = float(total_tokens) if total_tokens is not None else (of.agg(F.min(F.col("held") * F.col("passes") / F.col("w"))).first()[0] or 0.0)
    of = of.withColumn("budget", F.col("w") * F.lit(total)).withColumn("used", F.least(F.col("passes"), F.ceil(F.col("budget") / F.col("held")).cast("int"))).withColumn("buckets", F.ceil(F.col("docs") / F.lit(bucket_rows)).cast("int"))
    of = stage(of.select("source", "w", "budget", "held", "used", "buckets"))
    # One row for each source with a target; only where these are few they go to every task.
    each = one.join(F.broadcast(of) if of.count() <= FEW_SOURCES else of, "source").withColumn("pass", F.explode(F.sequence(F.lit(1), F.greatest("used", F.lit(1)))))
    each = each.withColumn("h", F.xxhash64("id", "pass", F.lit(seed))).withColumn("bucket", F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("buckets")).cast("int"), F.col("buckets") - 1))
    sums = each.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).select("source", "pass", "bucket", "before")
    near = each.join(sums, ["source", "pass", "bucket"]).where(F.col("before") < F.col("budget"))
    within = F.sum("tokens").over(Window.partitionBy("source", "pass", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    timed = near.withColumn("finish", (F.col("before") + within) / F.col("w")).where(F.col("finish") <= F.lit(total) * (1 + 1e-12))
    return timed.select("source", "id", "pass", "tokens", "finish").orderBy("finish", "source", "id")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_weight, tokens, share, documents, repeats): what each source has of the mix, 0 if nothing."""
    own = mixed.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("documents"), F.max("pass").alias("repeats"))
    joined = targets.select("source", "target_weight").join(own, "source", "left").withColumn("tokens", F.coalesce("t", F.lit(0)))
    return joined.select("source", "target_weight", "tokens", (F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1)))).alias("share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("repeats", F.lit(0)).alias("repeats"))
