import os

from moodfeed.operators.vectorize import stage_vectors
from moodfeed.sources import readers
from moodfeed.staging import stage_at


def files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_tables_are_stored_small(spark, tmp_path):
    """With zstd, about a third less than with the default; rows are as before."""
    rows = spark.createDataFrame([("a b", 0, 1, 2, 1.5, "en"), ("c", 1, 1, 2, 1.5, "fr")], readers.VOCABULARY_SCHEMA)
    stored = stage_at(rows, f"{tmp_path}/staged")
    readers.write_vocabulary(rows, f"{tmp_path}/vocabulary")
    readers.write_matrix(rows, f"{tmp_path}/matrix")
    for name in ("staged", "vocabulary", "matrix"):
        found = files(f"{tmp_path}/{name}")
        assert found and all("zstd" in f for f in found), name
    wanted = sorted(rows.collect())
    assert sorted(stored.collect()) == wanted
    assert sorted(readers.read_vocabulary(spark, f"{tmp_path}/vocabulary").collect()) == wanted
    assert sorted(readers.read_matrix(spark, f"{tmp_path}/matrix").collect()) == wanted


def test_vectors_are_stored_small(spark):
    rows = spark.createDataFrame([(1, "en"), (2, None)], "tweet_id long, lang string")
    entries = spark.createDataFrame([(1, 0, 1.0)], "tweet_id long, term_id long, tfidf double")
    sizes = spark.createDataFrame([("en", 3)], "lang string, n_terms long")
    vectors = stage_vectors(rows, entries, sizes, [])
    assert all("zstd" in f for f in vectors.inputFiles()) and vectors.inputFiles()
    assert {r.tweet_id: r.features.size for r in vectors.collect()} == {1: 3, 2: 0}
