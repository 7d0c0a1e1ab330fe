import inspect

from sentiero.operators import clustering
from sentiero.plans import registry


def test_kmeans_profiles_reads_the_whole_vector(spark, tmp_path):
    spread = lambda i: [float((i * 7 + j * 3) % 5) for j in range(8)]
    rows = [(i, spread(i // 4) + [100.0 * (i % 4 == j) + (i % 3) / 10 for j in range(4)] * 14) for i in range(80)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r["cluster"] for r in registry.queries()["kmeans_profiles"](spark, str(tmp_path)).collect()}
    assert [len({got[i] for i in range(80) if i % 4 == c}) for c in range(4)] == [1] * 4 and len(set(got.values())) == 4


def test_restarts_of_the_reference():
    assert inspect.signature(clustering.kmeans_groups).parameters["starts"].default == 30
