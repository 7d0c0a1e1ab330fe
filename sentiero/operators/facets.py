"""Faceted summaries: filters that combine over dimensions, counts that leave out their own dimension, shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "Non classificato"


def facet_filter(chosen: Mapping[str, Sequence[str]], leave_out: str | None = None) -> Column:
    """AND over dimensions, OR within; a dimension without choices doesn't filter, nor does ``leave_out``."""
    out = F.lit(True)
    for dimension, values in chosen.items():
        if values and dimension != leave_out:
            out = out & F.coalesce(F.col(dimension), F.lit(MISSING)).isin(*values)
    return out


def facet_counts(df: DataFrame, dimensions: Sequence[str], chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """(dimensione, valore, n, quota): counts per value of each dimension under the others' filters, and their share.

    One pass: each row is exploded to the dimensions it counts in.
    """
    entries = F.array(*[F.struct(F.lit(d).alias("dimensione"), F.coalesce(F.col(d).cast("string"), F.lit(MISSING)).alias("valore"), facet_filter(chosen, d).alias("counts")) for d in dimensions])
    counted = df.select(F.explode(entries).alias("e")).select("e.*").where("counts").groupBy("dimensione", "valore").agg(F.count("*").alias("n"))
    totals = counted.groupBy("dimensione").agg(F.sum("n").alias("all"))
    return counted.join(F.broadcast(totals), "dimensione").select("dimensione", "valore", "n", (F.col("n") / F.col("all")).alias("quota"))


def collated_counts(df: DataFrame, value: str, collation: str = "IT") -> DataFrame:
    """(value, n): counts, most frequent first, equal counts in the order of a language's collation. Nulls don't count."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.collate(value, collation), value)


def unpivot_summary(df: DataFrame) -> DataFrame:
    """(indicatore, valore): a one-row aggregate as rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("indicatore"), F.col(c).cast("double").alias("valore")) for c in df.columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")
