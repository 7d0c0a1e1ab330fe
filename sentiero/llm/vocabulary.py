"""What a corpus of names or addresses says about its own words: common words, which go together, places, towns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage
from .textnorm import typo_distance

#: A word is frequent if at least this share of the distinct values holds it, and at least so many of them.
FREQUENT_SHARE, FREQUENT_LEAST = 0.0005, 6
#: A frequent word is common, not a name, if at least this share of its values hold a rare word beside it.
BESIDE_RARE = 0.5
#: Letters of a rare word at least; shorter ones are mostly short forms.
RARE_LETTERS = 5
#: A further place of a postal code is written at least so often, and a misspelt one at most an eighth as often as its place.
PLACE_LEAST, MISSPELT = 3, 8
_ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüçñ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucn"


class Vocabulary(NamedTuple):
    """``words``: values that hold each common word; ``together``: values that hold two of them."""

    words: dict[str, int]
    together: dict[tuple[str, str], int]


def plain_letters(text: Column) -> Column:
    """Lower case without the accents of western Europe."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def common_words(values: DataFrame) -> Vocabulary:
    """The common words (of three letters or more, not abbreviated) of the distinct ``values`` (value).

    Names differ by their rare words, and what stands beside many rare words is a kind, a given name or the like.
    Collected to the driver: frequent words number at most the words of an average value divided by ``FREQUENT_SHARE``,
    whatever the number of rows; pairs are kept from a quarter of that frequency. No values give an empty vocabulary.
    """
    plain = plain_letters("value")
    text = F.when(F.col("value").rlike("['’]"), F.regexp_replace(plain, r"\b(?:d|l|dell|all|nell|sull|dall|un)['’]", " ")).otherwise(plain)
    held = values.where(F.col("value").isNotNull()).select(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![a-z.])([a-z]{3,})(?![a-z.])"))).alias("held"))
    held = stage(held)  # read three times
    n = held.count()
    least = max(FREQUENT_LEAST, FREQUENT_SHARE * n)
    frequent = sorted(r[0] for r in held.select(F.explode("held").alias("w")).groupBy("w").count().where(F.col("count") >= least).select("w").collect())
    if not frequent:
        return Vocabulary({}, {})
    own = held.select(F.filter("held", lambda w: w.isin(frequent)).alias("own"), F.exists("held", lambda w: (F.length(w) >= RARE_LETTERS) & ~w.isin(frequent)).alias("rare")).groupBy("own", "rare").agg(F.count("*").alias("n"))
    own = own.select("own", "rare", "n", F.explode("own").alias("w"))
    beside = {r["w"]: (r["all"], r["beside"]) for r in own.groupBy("w").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("rare"), F.col("n")).otherwise(0)).alias("beside")).collect()}
    words = {w: a for w, (a, b) in beside.items() if b >= BESIDE_RARE * a}
    pairs = own.select("w", F.explode("own").alias("v"), "n").where("w <> v").groupBy("w", "v").agg(F.sum("n").alias("n")).where(F.col("n") >= least / 4)
    return Vocabulary(words, {(r["w"], r["v"]): r["n"] for r in pairs.collect() if r["w"] in words and r["v"] in words})


class Gazetteer(NamedTuple):
    """``by_code``: place of each postal code, and for a code that several places share each of them by "code place";
    ``towns``: municipalities that stand behind several places."""

    by_code: dict[str, str]
    towns: frozenset[str]


def gazetteer(values: DataFrame) -> Gazetteer:
    """Place names learnt from addresses ``values`` (value).

    A postal code's place is the word most often written after it, and any other word written there three times or more
    that isn't a misspelling of a commoner one; a town is what at least two such places are said to belong to ("place di
    town"). Postal codes have five to seven digits. Collected to the driver: the places, which are as many as there are
    localities, whatever the number of rows, and no more than 100,000 towns.
    """
    text = plain_letters("value")
    # Each pattern is searched once, and only where a plain test lets it be there.
    coded = values.where(F.col("value").rlike(r"\d{5}")).select(F.regexp_extract(text, r"\b\d{5,7}\s+[\p{L}']{3,}", 0).alias("m")).where("m <> ''")
    found = coded.select(F.regexp_extract("m", r"^\d+", 0).alias("code"), F.regexp_extract("m", r"[\p{L}']+$", 0).alias("place"))
    counted = found.groupBy("code", "place").count().withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("count"), F.desc("place"))))
    by_code: dict[str, str] = {}
    listed: dict[str, list[tuple[int, str]]] = {}
    for r in counted.where((F.col("r") == 1) | (F.col("count") >= PLACE_LEAST)).collect():
        listed.setdefault(r["code"], []).append((r["count"], r["place"]))
    belongs = values.select(text.alias("t")).where(F.contains("t", F.lit(" di "))).select(F.split(F.regexp_extract("t", r"\b[\p{L}']{3,} di [\p{L}']{3,}", 0), " di ").alias("m")).where(F.size("m") == 2)
    said = belongs.select(F.col("m")[0].alias("place"), F.col("m")[1].alias("town")).groupBy("place", "town").count()
    places = found.select("place").distinct()
    towns = said.join(places, "place", "left_semi").groupBy("town").agg(F.count("*").alias("places")).where("places >= 2").orderBy(F.desc("places"), "town").limit(100_000)
    towns = frozenset(r["town"] for r in towns.collect()) - {max(options)[1] for options in listed.values()}
    for code, options in listed.items():
        kept: list[tuple[int, str]] = []
        for n, place in sorted(options, reverse=True):
            if not (kept and place in towns) and not any(m >= MISSPELT * n and typo_distance(place, p) <= 2 for m, p in kept):
                kept.append((n, place))
        by_code |= {code: kept[0][1]} if len(kept) == 1 else {f"{code} {place}": place for _, place in kept}
    return Gazetteer(by_code, towns)
