import pytest
from oracle import check

from sentiero.llm import queries as Q

COLUMNS = {
    "p1_found": ["service_row", "poi_id"],
    "p2_found": ["sez21_id_a", "sez21_id_b"],
    "p3_found": ["nome_a", "nome_b"],
    "p5_found": ["indirizzo_a", "indirizzo_b"],
    "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    got = df.collect()
    assert got
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(set(got)) == len(got)
        if len(df.columns) == 2 and name != "p1_found":
            assert all(r[0] < r[1] for r in got)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    check(spark, sf_dir, Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize("query", ["p3", "p5"])
def test_classes_and_pairs_say_the_same(spark, sf_dir, query):
    """The pairs of a query are the pairs of its classes."""
    by = {}
    for r in Q.queries()[f"{query}_classes"](spark, sf_dir).collect():
        if r[1] is not None:
            by.setdefault(r[1], []).append(r[0])
    want = {(a, b) for c in by.values() for a in c for b in c if a < b}
    assert {tuple(r) for r in Q.queries()[f"{query}_found"](spark, sf_dir).collect()} == want
