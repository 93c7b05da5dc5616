"""Sharding (1) and mixing (8)."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from moodfeed.llm import mixture, queries, shards


def test_shards_are_even_and_gapless(spark, small):
    rows = queries.op1_kd_shards(spark, small).collect()
    texts = {r.doc_id: r.text for r in queries.documents(spark, small).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    weight, slots = Counter(), defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert (r.law, r.grown_shard) == ("bytes", None)
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # a cut is off by half a document at most, at each of the six levels
    largest, mean = max(r.size for r in rows), sum(weight.values()) / 40
    assert all(abs(w - mean) <= 3 * largest for w in weight.values())


def test_shards_of_many_equal_documents_are_even(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    placed = shards.kd_shards(docs, ["text"], "shard", 8)
    counts = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 0.02 * 500


def test_equal_texts_stay_together(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1000)).alias("text")
    )
    placed = shards.kd_shards(docs, ["text"], "shard", 8)
    split = placed.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert split <= 7  # one group at each cut


def test_leaves_reach_the_target_size(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x" * 84).alias("text"))
    placed = shards.kd_shards(docs, ["text"], "shard", target_bytes=10_000)
    assert placed.select("shard").distinct().count() == 10


def test_awkward_documents_get_shards(awkward, nothing):
    placed = shards.kd_shards(awkward, ["n_chars", "lang"], "own_shard", 3)
    assert placed.columns == [*awkward.columns, "own_shard"]
    assert placed.count() == awkward.count()
    assert placed.where("own_shard IS NULL").count() == 0
    assert shards.with_slots(placed, "own_shard", "slot").count() == awkward.count()
    assert shards.kd_shards(nothing, ["n_chars"], "own_shard", 3).count() == 0


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, full = {}, sum(sizes.values()), set()
    while True:
        share = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / share > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / share for s in names if s not in full}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        full |= over


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 1000, "c": 5, None: 400}, {"a": 7}, {"a": 0, "b": 3}, {"a": 1, "b": 1, "c": 1000}]
)
def test_targets_fill_up_like_water(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixture.targets(table, (1, 2, 3), 3).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_sources_meet_their_targets(spark, small):
    rows = queries.op8_mixture(spark, small).collect()
    sources = {r.doc_id: r.source for r in queries.documents(spark, small).collect()}
    taken, target = Counter(), {}
    for r in rows:
        assert r.taken <= 3 * r.size
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    again = queries.op8_mixture(spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_whole_copies_come_near_the_target(spark):
    docs = spark.range(20000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.lit("some words of a text").alias("text"),
    )
    rows = mixture.mix(docs, "m").groupBy("source").agg(
        F.sum(F.col("m.copies") * F.col("m.size")).alias("words"), F.max("m.target").alias("target")
    )
    assert all(abs(r.words - r.target) <= 5 for r in rows.collect())


def test_awkward_documents_are_mixed(awkward, nothing):
    mixed = mixture.mix(awkward, "own")
    assert mixed.columns == [*awkward.columns, "own"]
    assert mixed.count() == awkward.count()
    assert mixed.where("own.taken > 3 * own.size OR own.taken IS NULL").count() == 0
    assert mixture.mix(nothing, "own").count() == 0
