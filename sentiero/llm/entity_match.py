"""Matching entities across sources without keys: BM25 over all attributes, exact top-k, mutual nearest, confidence."""

from __future__ import annotations



import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage
from .addresses import read_addresses
from .names import given_fits, read_names, words_fit
from .vocabulary import common_words, gazetteer

K1, B = 1.2, 0.3
#: Weights of the tokens: whole words, their first and last letters, their consonants or vowels, common words, other attributes.
WORD, EDGE, BONES, COMMON, STREET, STREET_EDGE, OTHER = 0.8, 1.2, 1.0, 0.5, 1.0, 0.5, 0.5
#: Letters of a word's edges that are indexed, and of a name's word of ``LONG`` letters or more.
EDGE_LETTERS, LONG, LONG_EDGE = 5, 8, 6
#: A document is a candidate only if its name reaches this share of what the query's name tokens can give.
LEAST_SHARE = 0.15
#: Letters that are told apart, and how many of a kind a word must have to be known by them.
VOWELS, CONSONANTS, LEAST_CONSONANTS, LEAST_VOWELS = "aeiou", "bcdfghjklmnpqrstvwxyz", 3, 4
#: Documents kept for each query, and the share of the best score from which on further ones are kept too.
TOP_K, WITHIN = 10, 0.75
#: Least confidence of a match, and least share of letters that the proper tokens and the streets of a match agree in.
CONFIDENCE, ALIKE = 0.35, 0.7
#: Labelled pairs the calibration is fitted on at most; every pair gets its confidence from the fit.
CALIBRATION_ROWS = 20_000


def _head(w: Column) -> Column:
    return F.left(w, F.lit(EDGE_LETTERS))


def _tail(w: Column) -> Column:
    return F.right(w, F.lit(EDGE_LETTERS))


def _edge(w: Column) -> Column:
    return F.when(F.length(w) >= LONG, LONG_EDGE).otherwise(EDGE_LETTERS)


def _single(w: Column) -> Column:
    return F.regexp_replace(w, r"(.)\1+", "$1")


def _consonants(w: Column) -> Column:
    """A word's consonants in order, doubled ones once: vowels mistaken and neighbours swapped leave them whole."""
    c = F.translate(w, VOWELS, "")
    return F.when(F.length(c) >= LEAST_CONSONANTS, _single(c)).otherwise(w)


def _vowels(w: Column) -> Column:
    """A word's vowels in order, doubled ones once, between its first and last consonant."""
    v, c = F.translate(w, CONSONANTS, ""), F.translate(w, VOWELS, "")
    return F.when(F.length(v) >= LEAST_VOWELS, F.concat(F.left(c, F.lit(1)), _single(v), F.right(c, F.lit(1)))).otherwise(w)


def _parts(field: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(field), F.lit("")), r"[ |]"), lambda w: w != "")


def profile_tokens(df: DataFrame) -> DataFrame:
    """(id, name_tokens, name_boosts, place_tokens, place_boosts) of profiles (id, activity, word, given, ordinal, kind,
    street, locality).

    Every attribute is indexed: words as written, the first and last letters of each (so that a typing error leaves one
    end whole), its consonants and its vowels (so that errors at both ends may leave one of these whole), common words,
    given name, ordinal, street, kind and locality. The civic number is held out.
    """

    def tokens(label: str, field: str, boost: float, change=lambda w: w) -> Column:
        return F.transform(_parts(field), lambda w: F.struct(F.xxhash64(F.lit(label), change(w)).alias("token"), F.lit(boost).cast("float").alias("boost")))

    name = F.array_distinct(F.concat(tokens("n", "word", WORD), tokens("p", "word", EDGE, lambda w: F.left(w, _edge(w))), tokens("s", "word", EDGE, lambda w: F.right(w, _edge(w))), tokens("c", "word", BONES, _consonants), tokens("v", "word", BONES, _vowels), tokens("a", "activity", COMMON), tokens("g", "given", OTHER), tokens("o", "ordinal", OTHER)))
    place = F.array_distinct(F.concat(tokens("t", "street", STREET), tokens("tp", "street", STREET_EDGE, _head), tokens("ts", "street", STREET_EDGE, _tail), tokens("k", "kind", OTHER), tokens("l", "locality", OTHER)))
    both = df.select("id", name.alias("n"), place.alias("p"))
    return both.select("id", *[F.col(f"{c}.{of}").alias(f"{to}_{of}s") for c, to in (("n", "name"), ("p", "place")) for of in ("token", "boost")])


def site_keys(df: DataFrame, asked: bool) -> DataFrame:
    """(id, sites) of profiles (id, street, civic): keys that an asked profile and a held one share if their streets agree
    in the first or last letters of a word and their civic numbers are equal or one has none, or in a word's consonants
    and the civic numbers are equal."""
    civic, edges = F.col("civic"), (("p", _head), ("s", _tail))
    # A held profile stands under its number and under any ("*"); who has a number asks for it and for none.
    if asked:
        numbers = F.when(civic == "", F.array(F.lit("*"))).otherwise(F.array(civic, F.lit("")))
    else:
        numbers = F.array(civic, F.lit("*"))

    def keys(word: Column) -> Column:
        forms = F.array(*[F.concat(F.lit(of), change(word)) for of, change in edges])
        by_edges = F.flatten(F.transform(numbers, lambda n: F.transform(forms, lambda f: F.xxhash64(f, n))))
        return F.concat(by_edges, F.when(civic != "", F.array(F.xxhash64(F.lit("c"), _consonants(word), civic))).otherwise(F.array().cast("array<bigint>")))

    return df.where("street <> ''").select("id", F.array_distinct(F.flatten(F.transform(_parts("street"), keys))).alias("sites"))


def bm25_candidates(queries: DataFrame, docs: DataFrame, k: int = TOP_K, within: float = WITHIN, least_share: float = LEAST_SHARE, place_share: float | None = None, sites: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Scored pairs (q, d, name, place, ideal, ideal_name, placed, named) of tables ``queries`` (id, name_tokens, name_boosts,
    place_tokens, place_boosts) and ``docs`` (id, name_tokens, place_tokens).

    ``name`` and ``place`` are the BM25 scores of the two kinds of tokens, each with its own length normalisation, so a
    document without a place isn't favoured. For each query come the k best documents by name + place, ties included,
    and all others that reach ``within`` of the best, among those whose name reaches ``least_share`` of what the query's
    name tokens can give; ``ideal`` and ``ideal_name`` are what all its tokens and those of its name can give, ``placed``
    tells that both sides have a place. With ``place_share`` the same is done beside it for the documents whose name doesn't
    reach its share (``named`` is false), among those whose place reaches ``place_share`` of what the query's place tokens
    can give: names with errors at both ends of a word are found by their place; with ``sites``, keys (id, sites) of the
    queries and of the documents, for all documents that share a key, whatever their score. The result is exact: the name's (place's) tokens are ordered by their upper bound, and only
    those are looked up that a document reaching the least share can't do without, since the others together stay below
    it. Queries without an indexed name token give no row.
    """
    length = lambda kind: F.when(F.size(f"{kind}_tokens") > 0, F.size(f"{kind}_tokens"))
    one = docs.agg(*[f(length(kind)).alias(f"{kind}_{n}") for kind in ("name", "place") for n, f in (("n", F.count), ("avg", F.avg))]).first()
    n = max(one["name_n"], one["place_n"])

    def norm(kind: str) -> Column:
        """A token's weight in a document is its idf times its boost in the query times this factor."""
        return ((K1 + 1) / (1 + K1 * (1 - B + B * F.size(f"{kind}_tokens") / F.lit(float(one[f"{kind}_avg"] or 1.0))))).cast("float")

    doc_tokens = docs.select(F.col("id").alias("d"), "name_tokens", norm("name").alias("name_norm"), "place_tokens", norm("place").alias("place_norm"))
    held = doc_tokens.select(F.explode(F.array(F.struct(F.col("name_tokens").alias("ts"), F.col("name_norm").alias("f")), F.struct(F.col("place_tokens").alias("ts"), F.col("place_norm").alias("f")))).alias("k")).select(F.explode("k.ts").alias("token"), "k.f")
    known = held.groupBy("token").agg(F.count("*").alias("df"), F.max("f").alias("most")).withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).cast("float"))
    kinds = lambda of_name, kind: F.transform(F.arrays_zip(F.col(f"{kind}_tokens").alias("token"), F.col(f"{kind}_boosts").alias("boost")), lambda t: F.struct(t["token"].alias("token"), t["boost"].alias("boost"), F.lit(of_name).alias("of_name")))
    terms = queries.select("id", F.explode(F.concat(kinds(True, "name"), kinds(False, "place"))).alias("t")).select("id", "t.token", "t.boost", "t.of_name")
    by = Window.partitionBy("id")
    # Tokens no document holds count as the rarest, so that what is left of a misspelt name doesn't count as all of it.
    asked = terms.join(known.select("token", "idf", "most"), "token", "left").withColumn("idf", F.col("idf") * F.col("boost")).withColumn("known", F.col("idf") * F.col("most")).withColumn("ub", F.coalesce("known", F.col("boost") * math.log(1 + (n + 0.5) / 0.5)))
    upto = F.sum("known").over(Window.partitionBy("id", "of_name").orderBy("known", "token").rowsBetween(Window.unboundedPreceding, 0))
    asked = asked.withColumn("ideal", F.sum("ub").over(by)).withColumn("ideal_name", F.sum(F.when(F.col("of_name"), F.col("ub"))).over(by)).withColumn("ideal_place", F.sum(F.when(~F.col("of_name"), F.col("ub"))).over(by)).withColumn("upto", upto).withColumn("placed", F.max(~F.col("of_name")).over(by))
    needed = F.col("of_name") & (F.col("upto") >= least_share * F.col("ideal_name"))
    if place_share is not None:
        needed |= ~F.col("of_name") & (F.col("upto") >= place_share * F.col("ideal_place"))
    # One row a query: what it asks, with which weight, and which of it has to be looked up.
    term = F.when(F.col("idf").isNotNull(), F.struct("token", "idf", needed.alias("needed")))
    asked = stage(asked.where(F.col("ideal_name") > 0).groupBy(F.col("id").alias("q")).agg(F.collect_list(term).alias("terms"), *[F.first(c).cast("float").alias(c) for c in ("ideal", "ideal_name", "ideal_place")], F.first("placed").alias("placed")))
    wanted = asked.select("q", F.explode(F.filter("terms", lambda t: t["needed"])).alias("t")).select("q", "t.token", F.lit(False).alias("sited"))
    indexed = F.col("name_tokens") if place_share is None else F.concat("name_tokens", "place_tokens")
    lists = docs.select(F.col("id").alias("d"), F.explode(indexed).alias("token"))
    if sites is not None:
        wanted = wanted.unionByName(sites[0].select(F.col("id").alias("q"), F.explode("sites").alias("token"), F.lit(True).alias("sited")))
        lists = lists.unionByName(sites[1].select(F.col("id").alias("d"), F.explode("sites").alias("token")))
    pairs = wanted.join(lists, "token").groupBy("q", "d").agg(F.max("sited").alias("sited"))
    query_tokens = asked.select("q", F.col("terms.token").alias("want"), F.col("terms.idf").alias("idfs"), "ideal", "ideal_name", "ideal_place", "placed")
    scored = pairs.join(doc_tokens, "d").join(query_tokens, "q")

    def total(kind: str) -> Column:
        idf = lambda t: F.coalesce(F.get("idfs", (F.array_position("want", t) - 1).cast("int")), F.lit(0.0).cast("float"))
        return (F.aggregate(F.transform(f"{kind}_tokens", idf), F.lit(0.0), lambda s, w: s + w) * F.col(f"{kind}_norm")).cast("float").alias(kind)

    scored = scored.select("q", "d", "sited", total("name"), total("place"), "ideal", "ideal_name", "ideal_place", ((F.size("place_tokens") > 0) & F.col("placed")).alias("placed"))
    scored = scored.withColumn("named", F.col("name") >= least_share * F.col("ideal_name") - 1e-4)
    by_place = F.lit(False) if place_share is None else F.col("place") >= place_share * F.col("ideal_place") - 1e-4
    scored = scored.where(F.col("named") | F.col("sited") | by_place)
    scored = scored.withColumn("score", F.col("name") + F.col("place"))
    among = Window.partitionBy("q", "named")
    ranked = scored.withColumn("r", F.rank().over(among.orderBy(F.desc("score")))).withColumn("best", F.max("score").over(among))
    return ranked.where((F.col("r") <= k) | (F.col("score") >= within * F.col("best")) | F.col("sited")).select("q", "d", "name", "place", "ideal", "ideal_name", "placed", "named", "sited")


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Weights (intercept first) of a logistic regression by Newton steps."""
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _edits(a: str, b: str) -> Column:
    return F.when(F.col(a) == F.col(b), 0).otherwise(F.levenshtein(F.col(a), F.col(b)))


def _alike(a: str, b: str, edits: str) -> Column:
    """Share of letters two texts agree in, by edit distance (column ``edits``); null where one is empty.

    Or that of their consonants followed by their vowels if it's greater: a vowel and a consonant swapped are one slip.
    """
    longest, sorted_ = F.greatest(F.length(a), F.length(b)), lambda c: F.concat(F.translate(F.col(c), VOWELS, ""), F.translate(F.col(c), CONSONANTS, ""))
    plain = F.col(edits)
    least = F.when(plain <= 1, plain).otherwise(F.least(plain, F.levenshtein(sorted_(a), sorted_(b))))
    return F.when((F.col(a) != "") & (F.col(b) != ""), F.when(plain == 0, 1.0).otherwise(1 - least / longest))


NAME_FIELDS = ["activity", "word", "given", "ordinal"]
PLACE_FIELDS = ["kind", "street", "civic", "locality"]
#: What the confidence is made of, with a street on both sides and without.
FEATURES = {True: ["gap_q", "gap_d", "share", "alike", "alike_street", "near"], False: ["name_gap_q", "name_gap_d", "name_share", "alike", "near", "settled"]}


def match_entities(services: DataFrame, pois: DataFrame) -> DataFrame:
    """Candidates (service_id, poi_id, score, confidence, matched) of services and POIs, both (id, name, address).

    Services ask the inverted index of all POI profiles (equal profiles once) for their exact top k by name, and for that of
    the others at their site (``site_keys``), however their names are misspelt; a pair stays if it
    is also near from the POI's side: among the POI's k best services, within the share of its best or at its site. Confidence is the
    probability that the civic numbers agree, an attribute that is held out of the index: a logistic fit of that
    agreement to the score gaps on either side, the share of the score that the query can reach, the letters agreed in
    and whether these are ``ALIKE`` or more (names with a slip are much likelier to be one than their letters alone tell) and, without a street, whether the name's
    bearers have one place in the main, on at most ``CALIBRATION_ROWS`` pairs that carry both numbers; every pair gets its confidence from the fit. Where
    a side has no street, only what concerns the name counts. ``matched``: confidence of ``CONFIDENCE`` or more, and nothing in the two
    records speaks against it: proper tokens alike, ordinal, given name and common words, civic number, locality and
    street kind not at odds; where a civic number is missing, the bearers of the name have one place in the main.
    Null names or addresses are read as missing; repeated rows count once; empty tables give no rows; long texts are
    read whole. Words that a third of all rows hold weigh little and are then not looked up.
    """
    clean = lambda df: df.select("id", "name", "address").where(F.col("id").isNotNull()).distinct()
    rows = stage(clean(services).withColumn("of", F.lit("s")).unionByName(clean(pois).withColumn("of", F.lit("p"))))
    names, places = rows.select(F.col("name").alias("value")).where("value is not null").distinct(), rows.select(F.col("address").alias("value")).where("value is not null").distinct()
    where = gazetteer(places)
    named = read_names(names, where, common_words(names)).select(F.col("value").alias("name"), "activity", "word", "given", F.col("number").alias("ordinal"))
    placed = read_addresses(places, where).select(F.col("value").alias("address"), "kind", F.col("word").alias("street"), F.concat_ws("/", F.when(F.col("number") != "", F.col("number")), F.when(F.col("suffix") != "", F.col("suffix"))).alias("civic"), "locality")
    fields = [*NAME_FIELDS, *PLACE_FIELDS]
    full = rows.join(named, "name", "left").join(placed, "address", "left").select(F.col("id").alias("row"), "of", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields])
    full = stage(full.withColumn("id", F.xxhash64(*fields)))
    # Where the bearers of a name are: the share of their commonest place, known by civic number and the street's first letter.
    bearer = F.when(F.col("word") != "", F.xxhash64("word", "activity", "ordinal")).otherwise(F.col("id"))
    home = F.when((F.col("street") != "") & (F.col("civic") != ""), F.xxhash64(F.left("street", F.lit(1)), "civic"))
    borne = full.select("of", "id", *fields, bearer.alias("bearer"), home.alias("home")).repartition("bearer")
    # One shuffle: all that follows is by bearer.
    borne = borne.withColumn("n", F.count("home").over(Window.partitionBy("bearer", "home")))
    borne = borne.withColumn("main", F.try_divide(F.max("n").over(Window.partitionBy("bearer")), F.count("home").over(Window.partitionBy("bearer"))).cast("float"))
    borne = borne.withColumn("r", F.row_number().over(Window.partitionBy("bearer", "id", "of").orderBy("home"))).where("r = 1")
    profiles = stage(borne.select("of", "id", *fields, F.coalesce("main", F.lit(1.0)).alias("main")))
    q, d = profiles.where("of = 's'"), profiles.where("of = 'p'")
    slim = bm25_candidates(profile_tokens(q), profile_tokens(d), sites=(site_keys(q, True), site_keys(d, False))).withColumn("score", F.col("name") + F.col("place"))

    def gap(of: str, c: str) -> Column:
        """Share of the best of the candidates by name; those by place only are set against all."""
        best = F.max(F.when(F.col("named"), F.col(of))).over(Window.partitionBy(c))
        return F.coalesce(F.try_divide(of, F.when(F.col("named"), best).otherwise(F.max(of).over(Window.partitionBy(c)))), F.lit(0.0))

    slim = slim.withColumns({"gap_q": gap("score", "q"), "name_gap_q": gap("name", "q")}).withColumns({"gap_d": gap("score", "d"), "name_gap_d": gap("name", "d"), "rank_d": F.rank().over(Window.partitionBy("d", "named").orderBy(F.desc("score")))})
    slim = slim.where(F.col("sited") | (F.col("rank_d") <= TOP_K) | (F.col("gap_d") >= WITHIN) | (~F.col("placed") & (F.col("name_gap_d") >= WITHIN)))
    # The fields travel as one text.
    side = lambda df, c: df.select(F.col("id").alias(c), F.concat_ws("\t", *fields).alias(f"{c}_all"), F.col("main").alias(f"{c}_main"))
    pairs = slim.join(side(d, "d"), "d").join(side(q, "q"), "q").withColumns({f"{c}_all": F.split(f"{c}_all", "\t", -1) for c in "qd"})
    pairs = pairs.select("*", *[F.col(f"{c}_all")[i].alias(f"{c}_{f}") for c in "qd" for i, f in enumerate(fields)])
    # The distance is used several times and computed once.
    pairs = pairs.withColumns({f"edits_{f}": _edits(f"q_{f}", f"d_{f}") for f in ("word", "street")})
    at = lambda f: (F.col(f"q_{f}"), F.col(f"d_{f}"))
    fits = lambda f: (F.col(f"q_{f}") == F.col(f"d_{f}")) | (F.col(f"q_{f}") == "") | (F.col(f"d_{f}") == "")
    settled = F.least("q_main", "d_main") >= 0.5
    lacking = (F.col("q_civic") == "") | (F.col("d_civic") == "")
    alike, alike_street = F.coalesce(_alike("q_word", "d_word", "edits_word"), F.lit(0.0)), F.coalesce(_alike("q_street", "d_street", "edits_street"), F.lit(0.0))
    one_name = (alike >= ALIKE) & (F.col("q_ordinal") == F.col("d_ordinal")) & words_fit(*at("activity")) & given_fits(*at("given"))
    one_place = fits("civic") & fits("locality") & fits("kind") & (~F.col("placed") | (alike_street >= ALIKE)) & (~lacking | settled)
    # From here on a pair is a row of numbers.
    single = lambda c, n: c.cast("float").alias(n)
    pairs = pairs.select("q", "d", "placed", "named", single(settled, "settled"), single(F.col("score"), "score"), *[single(F.col(c), c) for c in ("gap_q", "gap_d", "name_gap_q", "name_gap_d")], single(F.coalesce(F.try_divide("score", "ideal"), F.lit(0.0)), "share"), single(F.coalesce(F.try_divide("name", "ideal_name"), F.lit(0.0)), "name_share"), single(alike, "alike"), single(alike_street, "alike_street"), single(alike >= ALIKE, "near"), F.when(~lacking, F.col("q_civic") == F.col("d_civic")).alias("agree"), (one_name & one_place).alias("same"))
    pairs = stage(pairs)
    with_place, without = _calibrated(pairs, [FEATURES[True], FEATURES[False]])
    rated = pairs.withColumn("confidence", F.when(F.col("placed"), with_place).otherwise(without))
    rated = rated.select("q", "d", F.col("score").cast("double").alias("score"), "confidence", (F.col("same") & (F.col("confidence") >= CONFIDENCE)).alias("matched"))
    ids = lambda of, row, c: full.where(F.col("of") == of).select(F.col("row").alias(row), F.col("id").alias(c))
    out = rated.join(ids("s", "service_id", "q"), "q").join(ids("p", "poi_id", "d"), "d")
    return out.select("service_id", "poi_id", "score", "confidence", "matched")


def _calibrated(pairs: DataFrame, kinds: list[list[str]]) -> list[Column]:
    """Confidence by each of the lists of features: logistic fits to one bounded sample of pairs labelled by the held-out
    civic numbers."""
    both = pairs.where(F.col("agree").isNotNull() & F.col("placed") & F.col("named"))
    n = both.count()
    sample = both if n <= CALIBRATION_ROWS else both.sample(CALIBRATION_ROWS / n, seed=11).limit(2 * CALIBRATION_ROWS)
    at = sample.select(*dict.fromkeys(f for features in kinds for f in features), "agree").toPandas()
    return [_fitted(at, features) for features in kinds]


def _fitted(at: pd.DataFrame, features: list[str]) -> Column:
    weights = fit_logistic(at[features].to_numpy(float), at["agree"].to_numpy(float)) if len(at) else np.zeros(len(features) + 1)
    z = F.lit(float(weights[0]))
    for w, f in zip(weights[1:], features, strict=True):
        z = z + F.lit(float(w)) * F.col(f)
    return 1 / (1 + F.exp(-z))
