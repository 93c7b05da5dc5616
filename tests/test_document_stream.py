"""The documents as a stream, of a table in one file or several."""

import pytest

from moodfeed import queries as q
from moodfeed.sources import fixtures


@pytest.mark.parametrize("files", [0, 2])
def test_documents_stream_from_a_file_or_a_folder(spark, tmp_path, files):
    texts = [(i, f"some words {i}\nand good lines", "en") for i in range(20)]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    path = tmp_path / "documents.parquet"
    if files:
        documents.repartition(files).write.parquet(str(path))
    else:
        documents.toPandas().to_parquet(path)
    scored = q.stream_score(spark, str(tmp_path))
    assert scored.count() == fixtures.tweets(spark, str(tmp_path)).count() == 40
