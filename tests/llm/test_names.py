import random
import time

import pytest

from sentiero.llm import textnorm
from sentiero.llm.name_parse import NameReader
from sentiero.llm.names import name_ids, same_name_pairs
from sentiero.llm.textnorm import NearIndex
from sentiero.llm.vocabulary import Gazetteer, Vocabulary, common_words, gazetteer

PLACES = Gazetteer({"99000": "dugosudoza", "99002": "sitotulovi"}, frozenset({"valdorsena"}))
_PAIRS = {("studio", "tecnico"): 90, ("studio", "dentistico"): 80, ("bar", "trattoria"): 90, ("pro", "loco"): 90, ("scuola", "primaria"): 90, ("asilo", "nido"): 90}
VOCABULARY = Vocabulary(
    {w: 100 for w in "alimentari studio tecnico dentistico farmacia officina parrucchiera bar trattoria pro loco scuola primaria asilo nido".split()},
    {p: n for (a, b), n in _PAIRS.items() for p in ((a, b), (b, a))},
)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Alimentari Bupirenari n. 3 ODV", ("alimentari", "bupirenari", (), "3")),
        ("Aliment. Bupirenari III", ("alimentari", "bupirenari", (), "3")),
        ("studio dentistico zibezivoga alessandro", ("dentistico studio", "zibezivoga", ("alessandro",), "")),
        ("Parr.ra Caterina Povoppageda A.S.D. - Sitotulovi", ("parrucchiera", "povoppageda", ("caterina",), "")),
        ("ACCONCIATURE RINA POVOPPAGEDA", ("parrucchiera", "povoppageda", ("caterina",), "")),
        ("Lucorarabe L., Officina soc. coop. soc.", ("officina", "lucorarabe", ("l",), "")),
        ("Asilo-Nido Gogonupopa", ("asilo nido", "gogonupopa", (), "")),
        ("Boduvifadu (P. Loco) SRL di Dugosudoza", ("loco pro", "boduvifadu", (), "")),
        ("ProLoco Boduvifadu", ("loco pro", "boduvifadu", (), "")),
        ("Comune di Valdorsena", ("comune", "valdorsena", (), "")),
        ("Valdorsena, Municipio", ("comune", "valdorsena", (), "")),
        ("S. Primaria Bimopagore", ("primaria scuola", "bimopagore", (), "")),
        ("Bar Fiore Bianco", ("bar", "bianco fiore", (), "")),
        ("Studio Tecn. D'Amico", ("studio tecnico", "amico", (), "")),
        ("-", None),
        ("", None),
        (None, None),
    ],
)
def test_reader(text, want):
    got = NameReader(VOCABULARY, frozenset(PLACES.by_code.values()), tuple(PLACES.towns)).read(text)
    assert (got and tuple(got)) == want


def test_reader_takes_any_text():
    reader = NameReader(VOCABULARY)
    for text in ("x" * 100_000, "1", "( @ -", "S.r.l.", "di di di", "\n", "n. 1", "Anna", "a. b. c.", "''", "日本 料理", "x" * 50_000 + " " + "y" * 50_000):
        reader.read(text)


def test_same_name_pairs(spark):
    one = ["Farmacia Lorguripade srl", "FARMACIA LORGURIPADE", "Farm. Lrguripade di Dugosudoza", '"Lorguripade - Farmacia"']
    two = ["Studio Tecnico Lella Zaripopica", "St. Tecn. Raffaella Zaripopica", "R. Zaripopica, Studio Tecnico"]
    apart = ["Bar Trattoria Lorguripade", "Farmacia Lorguripade 2", "Studio Tecnico Luigi Zaripopica", "Comune di Valdorsena", "Comune di Dugosudoza", "-", "", None]
    rows = [(v,) for v in [*one, one[1], one[1], *two, *apart]]
    df = spark.createDataFrame(rows, "value string")
    got = {tuple(r) for r in same_name_pairs(df, PLACES, VOCABULARY).collect()}
    assert got == {(a, b) for g in (one, two) for a in g for b in g if a < b}
    assert same_name_pairs(df.limit(0), PLACES).count() == 0
    assert name_ids(df.withColumnRenamed("value", "v").selectExpr("v AS value", "1 AS word", "2 AS n"), PLACES, VOCABULARY).count() == len({r[0] for r in rows if r[0] is not None})


def test_other_names_stay_apart(spark):
    names = ["Fondazione Bruno Kessler", "Fondazione Edmund Mach", "Bar Fiore Bianco", "Bar Monte Bianco", "Smith & Sons Plumbing", "Acme Plumbing", "Banca Intesa", "Amici della Musica", "Banda Musicale Intesa"]
    df = spark.createDataFrame([(n,) for n in names], "value string")
    assert same_name_pairs(df, PLACES).count() == 0
    long = ["a" * 60 + "bcdefghijklm" * 5, "a" * 60 + "bcdefgihjklm" + "bcdefghijklm" * 4, "a" * 60 + "xyzxyzxyzxyz" * 5]
    assert same_name_pairs(spark.createDataFrame([(n,) for n in long], "value string"), PLACES).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_another_vocabulary(spark, seed):
    """Names made of words of another language: kinds, short forms and misspellings are learnt from the corpus."""
    rnd = random.Random(seed)
    kinds = [("bakery",), ("garden", "centre"), ("driving", "school"), ("chess", "club"), ("walking", "club"), ("hardware",), ("joinery",), ("pharmacy",), ("language", "school"), ("garage",)]
    syllables = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    orgs = {}
    while len(orgs) < 150:
        word, kind = "".join(rnd.choice(syllables) for _ in range(5)), rnd.choice(kinds)
        made = set()
        for _ in range(6):
            w, k = word.capitalize(), [x.capitalize() for x in kind]
            r = rnd.random()
            if r < 0.15:
                k = [x[: rnd.randint(4, 5)] + "." for x in k]
            elif r < 0.3:
                i = rnd.randrange(1, len(word) - 1)
                w = (word[:i] + word[i + 1] + word[i] + word[i + 2 :]).capitalize()
            text = rnd.choice([f"{' '.join(k)} {w}", f"{w} - {' '.join(k)}", f"{w} ({' '.join(k)})", f"{' '.join(k)} {w} srl"])
            made.add(text.upper() if rnd.random() < 0.2 else text)
        orgs[word, kind] = made
    values = spark.createDataFrame([(n,) for made in orgs.values() for n in made], "value string")
    learnt = common_words(values.distinct()).words
    assert {w for k in kinds for w in k} <= learnt.keys()
    want = {(a, b) for made in orgs.values() for a in made for b in made if a < b}
    got = {tuple(r) for r in same_name_pairs(values, PLACES).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.97 * len(got)


def test_places_that_share_a_code(spark):
    """A locality in a name makes no other organisation, also where several localities share one postal code."""
    addresses = spark.createDataFrame([(f"Via Boracomuze {i}, 38100 {p}",) for p in ("Dugosudoza", "Mocagitevu", "Sitotulovi") for i in range(4)], "value string")
    names = [v for p in ("Dugosudoza", "Mocagitevu", "Sitotulovi") for v in (f"Officina Zaripopica @ {p}", f"Officina Zaripopica {p}", "Officina Zaripopica")]
    got = {tuple(r) for r in same_name_pairs(spark.createDataFrame([(v,) for v in names], "value string"), gazetteer(addresses), Vocabulary({"officina": 30}, {})).collect()}
    assert got == {(a, b) for a in names for b in names if a < b}


def test_many_places_are_looked_up_fast():
    """Looking a word up among very many costs no more than among few."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("bcdfglmnprstvz") + rnd.choice("aeiou") for _ in range(5))
    index = NearIndex({word() for _ in range(20_000)})
    index.find(word())
    began = time.process_time()
    for _ in range(100):
        index.find(word())
    assert time.process_time() - began < 0.5


def test_two_typos_without_a_table():
    """Up to two errors are told by comparing what lies between them; three and more by the table of all prefixes."""
    rnd = random.Random(6)
    for letters in ("ab", "aesq", "aeioumnstr"):
        for _ in range(3000):
            a = "".join(rnd.choice(letters) for _ in range(rnd.randrange(8)))
            b = list(a)
            for _ in range(rnd.randrange(4)):
                b[(i := rnd.randrange(len(b) + 1)) : i + rnd.randrange(3)] = [rnd.choice(letters) for _ in range(rnd.randrange(3))]
            b = "".join(b)
            assert textnorm.typo_distance(a, b) == min(3, textnorm.typo_distance(a, b, 3)), (a, b)
    assert textnorm._few_typos("abcd", "xbcy") == 3 and textnorm._few_typos("abcd", "sbcf") == 2
