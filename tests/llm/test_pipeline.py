"""The corpus pipeline, stage by stage against plain versions, and the registered SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from moodfeed.llm import oracles, queries

from .conftest import prose
from .test_texts import brute_classes, brute_verdicts


def test_stages_follow_each_other(spark, small):
    docs = queries.documents(spark, small)
    benchmark = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]

    named = stages["language_id"](spark, docs, small)
    assert named.columns == docs.columns
    lettered = {d for d, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in named.collect()} == lettered

    distinct = stages["near_dedup"](spark, named, small)
    classes = brute_classes({d: texts[d] for d in lettered})
    kept = [r.doc_id for r in distinct.collect()]
    assert sorted(kept) == sorted(set(classes.values()))

    clean = stages["decontaminate"](spark, distinct, small)
    judged = brute_verdicts([(d, texts[d]) for d in kept], benchmark)
    clean_ids = sorted(r.doc_id for r in clean.collect())
    assert clean_ids == sorted(v[0] for v in judged if not v[-1])

    mixed = stages["mix"](spark, clean, small)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(counts) <= set(clean_ids) and max(counts.values()) <= 3

    last = stages["shard"](spark, mixed, small)
    assert last.count() == mixed.count()
    assert set(docs.columns) < set(last.columns)


def test_run_gives_the_last_stage(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert "shard" in rows.columns and rows.count() > 0


def test_awkward_documents_pass_all_stages(spark, awkward, nothing, tmp_path):
    items = spark.createDataFrame([(1, prose(9, 30)), (2, None)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (awkward, nothing, awkward.withColumn("doc_id", F.lit(None).cast("long"))):
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, docs, str(tmp_path))
            if name != "shard":
                assert out.columns == docs.columns
            out.count()
            docs = out


@pytest.mark.parametrize("name", oracles.ORACLES)
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = con.sql(oracles.ORACLES[name])
    assert sorted(rows.columns) == columns
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    assert got == sorted(rows.select(*columns).fetchall())
