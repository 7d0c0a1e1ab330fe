"""Several values packed in one field: one row for each value, with its position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packed import split_packed


def explode_packed(df: DataFrame, key: str, fields: Sequence[str], arrived: str | None = None) -> DataFrame:
    """Rows (key, campo, posizione, valore) of the packed ``fields``.

    Repeated deliveries count once: of the rows with one key the last by ``arrived`` stands (ties: the greatest content;
    null keys are left out, null arrivals come first). Nulls, blank and nothing-saying fields give no row; an empty
    table gives none. Other columns are not read, so clashing names do no harm. Splitting is row-local and needs no
    shuffle but the one that takes the last delivery, whose partial aggregates are built before it.
    """
    content = F.struct(*[F.col(f"`{f}`") for f in fields])
    order = F.struct(F.col(f"`{arrived}`"), content) if arrived else content
    last = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__key")).agg(F.max_by(content, order).alias("__row"))

    def labelled(name: str):
        values = split_packed(F.col("__row").getField(name).cast("string"))
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("campo"), v["posizione"].alias("posizione"), v["valore"].alias("valore")))

    parts = F.flatten(F.array(*[labelled(f) for f in fields]))
    return last.select(F.col("__key").alias(key), F.explode(parts).alias("v")).select(key, "v.campo", "v.posizione", "v.valore")
