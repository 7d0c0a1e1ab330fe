import random

import pytest
from pyspark.sql import functions as F

from sentiero.llm.address_parse import AddressReader
from sentiero.llm.addresses import address_ids, same_address_pairs
from sentiero.llm.lexicon import blocking_codes, near_words
from sentiero.llm.textnorm import NearIndex, deletions, jaro_winkler, typo_distance
from sentiero.llm.vocabulary import Gazetteer, gazetteer

PLACES = Gazetteer({"99000": "dugosudoza", "99001": "mocagitevu"}, frozenset({"valdorsena"}))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("37,  V. D. Zaripopica, 99001 Mocagitevu (VX)", ("via", "zaripopica", "37", "", "mocagitevu", "", "")),
        ("F. Cutosubupi, 4 bis, Dugosudoza", ("", "cutosubupi", "4", "bis", "dugosudoza", "f", "")),
        ("1/ B, Piazza Santa Nedazufozu 99000 Dugosudoza", ("piazza", "nedazufozu", "1", "b", "dugosudoza", "", "")),
        ("3 vicolo 4 biravusoro", ("vicolo", "biravusoro", "3", "", "", "", "4")),
        ("Piaz.le Rogemanesì N.17", ("piazzale", "rogemanesi", "17", "", "", "", "")),
        ("S.da Nerutesilu 1", ("strada", "nerutesilu", "1", "", "", "", "")),
        ("VIA Boracomuze' nr. 5bis, 1° piano", ("via", "boracomuze", "5", "bis", "", "", "")),
        ("Fraz. Mocagitevu, Via Don Zaripopica, 21 bis", ("via", "zaripopica", "21", "bis", "mocagitevu", "", "")),
        ("Via dott. Francesco Boracomuzè", ("via", "boracomuze", "", "", "", "francesco", "")),
        ("Via IV Novembre 12", ("via", "novembre", "12", "", "", "", "4")),
        ("Via Monte Baldo 3", ("via", "baldo monte", "3", "", "", "", "")),
        ("vedi sito", None),
        ("-", None),
        ("", None),
        (None, None),
    ],
)
def test_reader(text, want):
    got = AddressReader(PLACES).read(text)
    assert (got and got[:7]) == want


def test_reader_takes_any_text():
    reader = AddressReader()
    for text in ("x" * 100_000, "1 2 3 4 5 6", "(((", "Via", "Via 3", "12345", "\n\n", "via via via 5", "°" * 50, "a. b. c. 1/", "Via " + "a b" * 2000 + " 3"):
        reader.read(text)


def test_distances():
    assert typo_distance("zaripopica", "zaripopica") == 0
    assert typo_distance("zaripopica", "zairpopica") == 1
    assert typo_distance("valdorsena", "valdorsella") == 3
    assert typo_distance("abcdef", "uvwxyz") == 3
    assert typo_distance("x" * 60 + "ab" + "y" * 60, "x" * 60 + "ba" + "y" * 60) == 1
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("", "a") == 0.0
    assert "acd" in deletions("abcd", 1) and "cd" not in deletions("abcd", 1)
    assert NearIndex(["alimentari", "farmacia"]).find("aliemntari") == [(1, "alimentari")]


def _mistyped(rnd, word, errors):
    for _ in range(errors):
        i = rnd.randrange(len(word) - 1)
        word = rnd.choice([word[:i] + word[i + 1 :], word[:i] + rnd.choice("aeiort") + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :]])
    return word


def test_long_and_short_lists_find_the_same():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randint(4, 9))) for _ in range(900)]
    long, short = NearIndex(words), [NearIndex(words[:300]), NearIndex(words[300:600]), NearIndex(words[600:])]
    for w in words[::9]:
        v = _mistyped(rnd, w, 1)
        want = sorted({x for i in short for x in i.find(v)})
        assert long.find(v) == want == sorted({(typo_distance(v, x), x) for x in set(words) if typo_distance(v, x) <= 2})


def test_codes_miss_no_near_word():
    """Words of any length within the error limit share a blocking code."""
    rnd = random.Random(5)
    for n in [*range(5, 46), 80, 300]:
        for _ in range(6):
            w = "".join(rnd.choice("abcdefghilmnoprstuvz") for _ in range(n))
            v = _mistyped(rnd, w, rnd.randint(1, 2))
            if v != w and typo_distance(w, v) <= (2 if min(len(w), len(v)) >= 7 else 1):
                assert set(blocking_codes(w)) & set(blocking_codes(v)), (w, v)


def test_near_words_against_brute_force(spark):
    rnd = random.Random(3)
    long = "boracomuzevalledugosudozamocagitevusitotulovi"
    words = ["zaripopica", "zairpopica", "zaripopca", "zripopca", "boracomuze", "boracomuxe", "short", "shrt", "other", None, "zaripopica", long, _mistyped(rnd, long, 1), _mistyped(rnd, long, 2), long * 3, _mistyped(rnd, long * 3, 2)]
    got = {(r["a"], r["b"]) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string"), 0.0).collect()}
    plain = sorted({w for w in words if w and len(w) >= 5})
    limit = lambda w: 2 if len(w) >= 7 else 1
    want = {(a, b) for a in plain for b in plain if a != b and typo_distance(a, b) <= min(limit(a), limit(b))}
    assert got == want


def test_same_address_pairs(spark):
    same = ["Via don Zaripopica 21 bis", "V. D. Zaripopica, 21/bis, 99001 Mocagitevu (VX)", "Mocagitevu - VIA ZARIPOPICA N. 21BIS", "Via don Zairpopica 21 bis"]
    other = ["Via don Zaripopica 21", "Via don Zaripopica 22 bis", "Piazza Zaripopica 21 bis, 99001 Mocagitevu", "Via don Zaripopica 21 bis, 99000 Dugosudoza", "Via Zaripopica 5, 99001 Mocagitevu", "Via Zaripopica 7, Mocagitevu", "vedi sito", "-", "", None, "Via don Zaripopica"]
    # forms without a locality belong to the street that is written three times as often as the one elsewhere
    rows = [(v, 1) for v in [*same, *same, *other]]
    df = spark.createDataFrame(rows, "value string, a int")
    got = {tuple(r) for r in same_address_pairs(df).collect()}
    assert got == {(a, b) for a in same for b in same if a < b}
    assert same_address_pairs(df.limit(0)).count() == 0
    assert gazetteer(df) == ({"99000": "dugosudoza", "99001": "mocagitevu"}, frozenset())
    ids = {r["value"]: r["address_id"] for r in address_ids(df).collect()}
    assert ids["vedi sito"] is None and ids["Via don Zaripopica"] is None and len(ids) == len({v for v, _ in rows if v is not None})


def test_other_streets_stay_apart(spark):
    apart = ["Via Monte Baldo 3", "Via Monte Zugna 3", "Via Francesco Rossi 4", "Via Giuseppe Rossi 4", "Via Rossi 4 bis", "Via IV Novembre 5", "Via XX Novembre 5"]
    assert same_address_pairs(spark.createDataFrame([(v,) for v in apart], "value string")).count() == 0
    same = ["Via Aldo Moro 7", "V. Moro, 7", "Via F. Rossi 4", "VIA FRANCESCO ROSSI N. 4", "Viale Quattro Novembre 2", "V.le 4 Novembre, 2", "Via Monte Baldo 3", "via m. baldo 3"]
    got = {tuple(r) for r in same_address_pairs(spark.createDataFrame([(v,) for v in same], "value string")).collect()}
    assert got >= {("V. Moro, 7", "Via Aldo Moro 7"), ("VIA FRANCESCO ROSSI N. 4", "Via F. Rossi 4"), ("V.le 4 Novembre, 2", "Viale Quattro Novembre 2")}


def test_towns_are_learnt(spark):
    rows = ["Via A 1, 10000 Alba", "Via B 2, 10001 Bruna", "Piazza C 3, Alba di Granvalle", "Piazza D 4 - Bruna di Granvalle", "Alba", None, ""]
    got = gazetteer(spark.createDataFrame([(v,) for v in rows], "value string"))
    assert got.towns == {"granvalle"} and got.by_code == {"10000": "alba", "10001": "bruna"}


def test_long_and_tied_values(spark):
    df = spark.createDataFrame([("Via Boracomuze 5" + " " * 50_000,), ("Via Boracomuze 5",), ("Via Boracomuxe 5",)], "value string")
    assert same_address_pairs(df).select(F.count("*")).first()[0] == 3


@pytest.mark.parametrize("codes", [("38100", "38100", "38100"), ("100012", "100013", "100014")])
def test_shared_and_long_postal_codes(spark, codes):
    """Places are known though several share a code, and codes may have more than five digits."""
    places = ["Dugosudoza", "Mocagitevu", "Sitotulovi"]
    rows = [f"Via Boracomuze {i}, {c} {p}" for c, p in zip(codes, places, strict=True) for i in range(1, 5)]
    rows += [f"{p} - via Boracomuze, 2" for p in places] + [f"via Boracomuze 3 {codes[0]} Dugosudzoa"]
    df = spark.createDataFrame([(v,) for v in rows], "value string")
    assert set(gazetteer(df).by_code.values()) == {p.lower() for p in places}
    got = {tuple(r) for r in same_address_pairs(df).collect()}
    want = {tuple(sorted((f"Via Boracomuze 2, {c} {p}", f"{p} - via Boracomuze, 2"))) for c, p in zip(codes, places, strict=True)}
    assert got == want | {tuple(sorted((f"Via Boracomuze 3, {codes[0]} Dugosudoza", rows[-1])))}


def test_a_misspelt_place_among_many():
    """A word near some place is no place where the locality is already named; a tie between places stays open."""
    at = AddressReader(Gazetteer({"99000": "dugosudoza", "99001": "mocagitevu", "99002": "mocagiteva"}, frozenset()))
    assert at.read("Dugosudoza, Mocagitevo 5")[1:5] == ("mocagitevo", "5", "", "dugosudoza")
    assert at.read("Mocagitevuu - Via Boracomuze 5")[:5] == ("via", "boracomuze", "5", "", "mocagitevu")
    assert at.read("Mocagitev - Via Boracomuze 5")[:5] == ("via", "boracomuze", "5", "", "")
