"""Composite indices of sections: scores, weighted sums, rounding before classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import SCORE_EDGES, SCORE_LABELS, bins, clip, mean_of
from .ranking import percentile_scores

#: Weights of the two indices.
ACCESS_WEIGHTS = {"score_servizi": 0.40, "score_trasporto_pubblico": 0.35, "score_facilita_territoriale": 0.25}
SOCIAL_WEIGHTS = {"indice_accessibilita": 0.65, "score_residenza": 0.35}


def composite_index(df: DataFrame, key: str, more: dict[str, Sequence[str]], less: dict[str, Sequence[str]]) -> DataFrame:
    """(key, four scores, two indices and their classes) of rows with a unique key.

    ``more`` and ``less`` name for each score the columns of which more, or less, is better; a score is the mean of the
    percentile scores of its columns, turned for ``less`` (50 where a value is missing or a score has no column).
    Indices are weighted sums; all are held to 0-100, rounded half-even to one digit and only then classed.
    """
    columns = list(dict.fromkeys(c for groups in (more, less) for cs in groups.values() for c in cs))
    scored = percentile_scores(df, key, columns)
    parts: dict[str, list] = {}
    for score, cs in more.items():
        parts.setdefault(score, []).extend(F.col(c) for c in cs)
    for score, cs in less.items():
        parts.setdefault(score, []).extend(100.0 - F.col(c) for c in cs)
    for score in (*ACCESS_WEIGHTS, "score_residenza"):
        scored = scored.withColumn(score, mean_of(*parts[score]) if score in parts else F.lit(50.0))
    weighted = lambda weights: sum((w * F.col(c) for c, w in list(weights.items())[1:]), list(weights.values())[0] * F.col(list(weights)[0]))
    scored = scored.withColumn("indice_accessibilita", weighted(ACCESS_WEIGHTS)).withColumn("indice_sociofunzionale", weighted(SOCIAL_WEIGHTS))
    rounded = {c: F.bround(clip(F.col(c), 0.0, 100.0), 1) for c in (*ACCESS_WEIGHTS, "score_residenza", "indice_accessibilita", "indice_sociofunzionale")}
    scored = scored.withColumns(rounded).drop(*columns)
    return scored.withColumn("classe_accessibilita", bins(F.col("indice_accessibilita"), SCORE_EDGES, SCORE_LABELS)).withColumn("classe_sociofunzionale", bins(F.col("indice_sociofunzionale"), SCORE_EDGES, SCORE_LABELS))
