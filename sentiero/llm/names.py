"""Variant spellings of names typed by people: phonetic blocks, Jaro-Winkler, nicknames, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import stage
from .lexicon import near_words
from .name_parse import NameReader
from .vocabulary import Gazetteer, Vocabulary, common_words


def read_names(values: DataFrame, places: Gazetteer, vocabulary: Vocabulary) -> DataFrame:
    """``values`` (value) with activity, word, given and number; null where the text holds no name."""
    shared = values.sparkSession.sparkContext.broadcast((places, vocabulary))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, words = shared.value
        reader = NameReader(words, frozenset(at.by_code.values()), tuple(at.towns))
        for batch in batches:
            parts = [reader.read(v) for v in batch["value"]]
            yield pd.DataFrame(
                {
                    "value": batch["value"].to_numpy(),
                    "activity": [p.activity if p else None for p in parts],
                    "word": [p.word if p else None for p in parts],
                    "given": ["|".join(p.given) if p else None for p in parts],
                    "number": [p.number if p else None for p in parts],
                }
            )

    return values.mapInPandas(read, "value string, activity string, word string, given string, number string")


def given_fits(a: Column, b: Column) -> Column:
    """Two sets of possible given names that may be one person: no name, a shared name, or a fitting initial."""
    x, y = F.split(a, r"\|"), F.split(b, r"\|")
    initial = ((F.length(a) == 1) & F.exists(y, lambda g: g.startswith(a))) | ((F.length(b) == 1) & F.exists(x, lambda g: g.startswith(b)))
    return (a == "") | (b == "") | F.arrays_overlap(x, y) | initial


def words_fit(a: Column, b: Column) -> Column:
    """Two texts of words of which one says no more than the other: one's words are all the other's."""
    x, y = F.split(a, " "), F.split(b, " ")
    return (a == b) | (a == "") | (b == "") | (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def _fits(a: Column, b: Column) -> Column:
    return (a == b) | (a == "") | (b == "")


def name_ids(values: DataFrame, places: Gazetteer, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Rows (value, org_id, activity, word, given, number) for the distinct non-null ``values`` (value).

    Names are read into common words (``common_words`` of the values unless ``vocabulary`` is given), sorted proper
    tokens, given name (pet forms by the nickname table) and ordinal; token order, legal forms, localities, quotes and
    case don't count. Classes with one ordinal are blocked by the phonetic codes of their sorted tokens with up to two
    letters lost, compared by Jaro-Winkler within the typing-error limit, and must not disagree in common words or given
    name. A pair is accepted if the rarer spelling may be a misspelling of the commoner: it stands at most twice or an
    eighth as often, and no commoner one is nearer to it; ties are all accepted. Connected components of all accepted
    pairs are the spellings of one name. Fewer common words, an initial or an ambiguous pet form are filled from the
    classes that carry the tokens, where one clearly stands out. Repeated values count as often as they occur. org_id is
    null for texts without a name; empty tables give no rows; values are whole texts of any length; other columns are
    not read.
    """
    counted = values.where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    counted = stage(counted)
    parsed = read_names(counted.select("value"), places, vocabulary or common_words(counted))
    read = stage(parsed.join(counted, "value"))
    keys = ["activity", "word", "given", "number"]
    classes = stage(read.where(F.col("word").isNotNull()).groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("id", F.xxhash64(*keys)))
    near = near_words(classes.select("word"))
    left = classes.join(near.withColumnRenamed("a", "word"), "word").select("id", "activity", "given", "number", "n", F.col("b").alias("other"), "d")
    right = classes.select(F.col("id").alias("id2"), F.col("activity").alias("a2"), F.col("given").alias("g2"), "number", F.col("n").alias("n2"), F.col("word").alias("other"))
    links = left.join(right, ["other", "number"]).where(words_fit(F.col("activity"), F.col("a2")) & given_fits(F.col("given"), F.col("g2")))
    stronger = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("id2") < F.col("id")))
    links = links.where(stronger & ((F.col("n") <= 2) | (F.col("n2") >= 8 * F.col("n"))))
    nearest = F.min("d").over(Window.partitionBy("id"))
    accepted = links.withColumn("least", nearest).where(F.col("d") == F.col("least"))
    linked = connected_components(accepted.select(F.col("id").alias("src"), F.col("id2").alias("dst")))
    members = classes.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spelling = members.groupBy("component").agg(F.max_by("word", F.struct("n", "word")).alias("root"))
    settled = stage(members.join(spelling, "component").select(*keys, "n", "root"))
    settled = stage(_fuller(settled, keys))
    # Who carries the tokens: common words and given name as known, the bare forms only where no fuller one is there.
    full = settled.where((F.col("act") != "") & ((F.length("given") > 1) & ~F.col("given").contains("|"))).groupBy("root", "number", "act", "given").agg(F.sum("n").alias("m"))
    plain = settled.where(F.col("act") != "").groupBy("root", "number", "act").agg(F.sum("n").alias("m"), F.max(F.length("given")).alias("g"), F.max("given").alias("given")).where(F.col("g") <= 1).select("root", "number", "act", "given", "m")
    bearers = full.unionByName(plain).select(F.col("root").alias("r2"), F.col("number").alias("k2"), F.col("act").alias("a2"), F.col("given").alias("g2"), "m")
    open_ = settled.where((F.col("act") == "") | F.col("given").contains("|") | (F.length("given") <= 1)).select(*keys, "root", "act")
    options = open_.join(bearers, (F.col("root") == F.col("r2")) & (F.col("number") == F.col("k2")) & _fits(F.col("act"), F.col("a2")) & given_fits(F.col("given"), F.col("g2")))
    by = Window.partitionBy(*keys, "root").orderBy(F.desc("m"), "a2", "g2")
    best = options.withColumn("r", F.row_number().over(by)).withColumn("second", F.lead("m", 1, 0).over(by)).where((F.col("r") == 1) & (F.col("m") >= 3 * F.col("second")))
    filled = settled.join(best.select(*keys, "root", "a2", "g2"), [*keys, "root"], "left")
    filled = filled.withColumn("act", F.coalesce("a2", "act")).withColumn("giv", F.coalesce("g2", "given"))
    named = filled.select(*keys, F.concat_ws("|", "act", "root", "giv", "number").alias("org_id"), "root", "act", "giv")
    return read.join(named, keys, "left").select("value", "org_id", F.coalesce("act", "activity").alias("activity"), F.coalesce("root", "word").alias("word"), F.coalesce("giv", "given").alias("given"), "number")


def _fuller(settled: DataFrame, keys: list[str]) -> DataFrame:
    """``settled`` with ``act``: the common words of each class, those of the one fullest form that contains them.

    "Officina" becomes "officina meccanica" where the same proper tokens are also called so; where several forms contain
    the words, only if one stands three times as often as the next. Classes without common words keep none here.
    """
    forms = settled.where(F.col("activity") != "").groupBy("root", "number", "activity").agg(F.sum("n").alias("m"))
    more = forms.select("root", "number", F.col("activity").alias("wide"), F.col("m").alias("m2"))
    inside = F.size(F.array_except(F.split("activity", " "), F.split("wide", " "))) == 0
    wider = forms.join(more, ["root", "number"]).where((F.col("activity") != F.col("wide")) & inside)
    # Only forms that no other form contains are ends; of these the commonest has to stand out.
    inner = wider.select("root", "number", F.col("activity").alias("wide")).distinct()
    ends = wider.join(inner, ["root", "number", "wide"], "left_anti")
    by = Window.partitionBy("root", "number", "activity").orderBy(F.desc("m2"), "wide")
    best = ends.withColumn("r", F.row_number().over(by)).withColumn("second", F.lead("m2", 1, 0).over(by)).where((F.col("r") == 1) & (F.col("m2") >= 3 * F.col("second")))
    return settled.join(best.select("root", "number", "activity", "wide"), ["root", "number", "activity"], "left").withColumn("act", F.coalesce("wide", "activity")).select(*keys, "n", "root", "act")


def same_name_pairs(values: DataFrame, places: Gazetteer, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Pairs (a, b), a before b by code point, of different ``values`` (value) that name the same organisation."""
    ids = stage(name_ids(values, places, vocabulary).where(F.col("org_id").isNotNull()).select("value", "org_id"))
    left, right = ids.select("org_id", F.col("value").alias("a")), ids.select("org_id", F.col("value").alias("b"))
    return left.join(right, "org_id").where(F.col("a") < F.col("b")).select("a", "b")
