"""The same postal address written differently: normalised forms, hashed and joined, conflicts rejected."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import stage
from .address_parse import Address, AddressReader
from .lexicon import near_words
from .names import given_fits
from .vocabulary import Gazetteer, gazetteer

#: What an address is read into; ``bare`` are the street's words without the leading one.
PARTS = list(Address._fields)


def read_addresses(values: DataFrame, places: Gazetteer) -> DataFrame:
    """``values`` (value) with ``PARTS``; null where the text names no street."""
    shared = values.sparkSession.sparkContext.broadcast(places)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = AddressReader(shared.value)
        for batch in batches:
            parts = [reader.read(v) or (None,) * len(PARTS) for v in batch["value"]]
            out = pd.DataFrame(parts, columns=PARTS, dtype=object)
            out.insert(0, "value", batch["value"].to_numpy())
            yield out

    return values.mapInPandas(read, "value string, " + ", ".join(f"{p} string" for p in PARTS))


def _fits(a: str, b: str):
    """Neither side says something else."""
    return (F.col(a) == F.col(b)) | (F.col(a) == "") | (F.col(b) == "")


def _standing_out(options: DataFrame, keys: list[str], found: list[str]) -> DataFrame:
    """The option of each key that stands three times as often (m) as the next one, or alone."""
    by = Window.partitionBy(*keys).orderBy(F.desc("m"), *found)
    return options.withColumn("r", F.row_number().over(by)).withColumn("second", F.lead("m", 1, 0).over(by)).where((F.col("r") == 1) & (F.col("m") >= 3 * F.col("second"))).select(*keys, *found)


def address_ids(values: DataFrame, places: Gazetteer | None = None) -> DataFrame:
    """Rows (value, address_id, kind, word, number, suffix, locality) for the distinct non-null ``values`` (value).

    Every value is read into its parts and expanded into all plausible forms: its street's words as written, with the
    leading word taken off if only one fuller street of this kind and place ends so, and in every spelling near them that
    occurs. A hash of (number, suffix, form) is exploded and equi-joined with the hashes of the forms as written; pairs
    whose street kind, locality, number, suffix, given name or numeral disagree are rejected. A pair is accepted if the
    rarer spelling may be a misspelling of the commoner: it stands at most three times or an eighth as often, and no
    commoner one is nearer; ties are all accepted, and connected components of all accepted pairs are one address. Then a
    missing kind, locality, given name or numeral is filled from the street that carries the words, where one clearly
    stands out. Place names come from ``gazetteer`` of the values unless given. address_id is null where the text has no
    street or no civic number. Empty tables give no rows; other columns are not read; values are whole texts of any length.
    """
    values = values.select("value").where(F.col("value").isNotNull())
    read = stage(read_addresses(values.distinct(), places or gazetteer(values)))
    keys = ["kind", "word", "number", "suffix", "locality", "given", "numeral"]
    forms = stage(read.where(F.col("word").isNotNull()).groupBy(*keys, "bare").agg(F.count("*").alias("n")))
    # "Via Moro" is "Via Aldo Moro" where no other street of the kind and place ends so.
    longer = forms.where(F.col("bare") != "").groupBy(F.col("bare").alias("short"), F.col("kind").alias("k2"), F.col("locality").alias("l2")).agg(F.min("word").alias("long"), F.max("word").alias("last")).where(F.col("long") == F.col("last")).drop("last")
    cut = forms.select("word", "kind", "locality").distinct().join(longer, F.col("word") == F.col("short")).where(_fits("kind", "k2") & _fits("locality", "l2"))
    cut = cut.groupBy("word", "kind", "locality").agg(F.min("long").alias("long"), F.max("long").alias("last")).where(F.col("long") == F.col("last")).drop("last")
    forms = forms.join(cut, ["word", "kind", "locality"], "left").withColumn("full", F.coalesce("long", "word"))
    counts = forms.groupBy("full").agg(F.sum("n").alias("total"))
    numbered = stage(forms.where(F.col("number") != "").join(counts, "full").groupBy(*keys, "full", "total").agg(F.sum("n").alias("n")).withColumn("f", F.xxhash64(*keys)))
    near = near_words(counts.select(F.col("full").alias("word")))
    key = lambda word: F.xxhash64("number", "suffix", word)
    spelled = numbered.join(near.withColumnRenamed("a", "full"), "full").select("f", "kind", "locality", "given", "numeral", F.col("total").alias("own"), F.col("b").alias("other"), "d", "number", "suffix", key(F.col("b")).alias("h"))
    written = numbered.select(F.col("f").alias("f2"), F.col("kind").alias("k2"), F.col("locality").alias("l2"), F.col("given").alias("g2"), F.col("numeral").alias("m2"), F.col("full").alias("w2"), F.col("total").alias("t2"), F.col("number").alias("n2"), F.col("suffix").alias("s2"), key(F.col("full")).alias("h"))
    links = spelled.join(written, "h").where((F.col("other") == F.col("w2")) & (F.col("number") == F.col("n2")) & (F.col("suffix") == F.col("s2")) & _fits("kind", "k2") & _fits("locality", "l2") & _fits("numeral", "m2") & given_fits(F.col("given"), F.col("g2")))
    links = links.where(((F.col("own") <= 3) & (F.col("t2") >= F.col("own"))) | (F.col("t2") >= 8 * F.col("own")))
    accepted = links.withColumn("least", F.min("d").over(Window.partitionBy("f"))).where(F.col("d") == F.col("least"))
    linked = connected_components(accepted.select(F.col("f").alias("src"), F.col("f2").alias("dst")))
    members = numbered.join(linked, F.col("f") == F.col("id"), "left").withColumn("component", F.coalesce("component", "f"))
    spelling = members.groupBy("component").agg(F.max_by("full", F.struct("total", "full")).alias("street"))
    settled = stage(members.join(spelling, "component").select(*keys, "n", "street"))
    # Whose street: given name and numeral as known, told apart only where the words have several.
    told = settled.where((F.col("given") != "") | (F.col("numeral") != "")).groupBy("street", "given", "numeral").agg(F.sum("n").alias("m")).withColumn("longest", F.max(F.length("given")).over(Window.partitionBy("street")))
    whose = told.where((F.length("given") > 1) | (F.col("longest") <= 1)).select(F.col("street").alias("st"), F.col("given").alias("g2"), F.col("numeral").alias("m2"), "m")
    unsure = settled.select("street", "given", "numeral").distinct().join(whose, (F.col("street") == F.col("st")) & _fits("numeral", "m2") & given_fits(F.col("given"), F.col("g2")))
    settled = settled.join(_standing_out(unsure, ["street", "given", "numeral"], ["g2", "m2"]), ["street", "given", "numeral"], "left").withColumn("who", F.concat_ws("/", F.coalesce("g2", "given"), F.coalesce("m2", "numeral"))).drop("g2", "m2")
    # Streets by words: kind and locality as written, the bare kind only where no locality is ever written with it.
    streets = settled.where((F.col("kind") != "") & (F.col("locality") != "")).groupBy("street", "who", "kind", "locality").agg(F.sum("n").alias("m"))
    bare = settled.where(F.col("kind") != "").groupBy("street", "who", "kind").agg(F.sum("n").alias("m"), F.max("locality").alias("top")).where(F.col("top") == "").select("street", "who", "kind", F.lit("").alias("locality"), "m")
    streets = streets.unionByName(bare).select(F.col("street").alias("st"), F.col("who").alias("w2"), F.col("kind").alias("k2"), F.col("locality").alias("l2"), "m")
    lacking = settled.where((F.col("kind") == "") | (F.col("locality") == "")).select("kind", "locality", "street", "who").distinct()
    options = lacking.join(streets, (lacking["street"] == streets["st"]) & (lacking["who"] == streets["w2"]) & _fits("kind", "k2") & _fits("locality", "l2"))
    filled = settled.join(_standing_out(options, ["kind", "locality", "street", "who"], ["k2", "l2"]), ["kind", "locality", "street", "who"], "left")
    filled = filled.withColumn("kind_id", F.coalesce("k2", "kind")).withColumn("locality_id", F.coalesce("l2", "locality"))
    named = filled.select(*keys, F.concat_ws("|", "kind_id", "street", "who", "locality_id", "number", "suffix").alias("address_id"), "street", "kind_id", "locality_id")
    return read.join(named, keys, "left").select("value", "address_id", F.coalesce("kind_id", "kind").alias("kind"), F.coalesce("street", "word").alias("word"), "number", "suffix", F.coalesce("locality_id", "locality").alias("locality"))


def same_address_pairs(values: DataFrame, places: Gazetteer | None = None) -> DataFrame:
    """Pairs (a, b), a before b by code point, of different ``values`` (value) that denote the same civic address."""
    ids = stage(address_ids(values, places).where(F.col("address_id").isNotNull()).select("value", "address_id"))
    left, right = ids.select("address_id", F.col("value").alias("a")), ids.select("address_id", F.col("value").alias("b"))
    return left.join(right, "address_id").where(F.col("a") < F.col("b")).select("a", "b")
