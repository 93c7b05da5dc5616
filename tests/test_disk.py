"""What is shuffled and kept on disk by staging, entries, unseen tweets and vectors."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from moodfeed.functions import tokens as tk
from moodfeed.operators import vectorize as vz
from moodfeed.staging import stage


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    sums = spark.range(1000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("s"))
    staged = stage(sums, "sums")
    assert not shuffle_files(spark) - before
    assert staged.agg(F.sum("s")).first()[0] == 499_500
    # what is not staged is as before
    assert sums.count() == sums.count() == 97


def corpus(spark, rows):
    return stage(spark.createDataFrame(rows, "tweet_id bigint, lang string, corpus string"), "corpus")


@pytest.mark.parametrize("hot", [1, 512])
def test_terms_are_moved_once_and_back_as_places(spark, monkeypatch, hot):
    monkeypatch.setattr(vz, "OWN_SHARE", hot)
    texts = {i: f"alpha w{i % 3} beta own{i} w{i % 4} gamma" for i in range(40)}
    _, matrix = vz.fit_transform(corpus(spark, [(i, "en", t) for i, t in texts.items()]), tk.whitespace_tokens, 1)
    got = {(r.tweet_id, r.term): r.tfidf for r in matrix.collect()}
    assert set(got) == {(i, w) for i, t in texts.items() for w in t.split()}
    df = Counter(w for t in texts.values() for w in set(t.split()))
    # rarer terms weigh more, and equally frequent ones the same
    for i, t in texts.items():
        order = sorted(set(t.split()), key=lambda w: df[w])
        assert all(got[i, a] >= got[i, b] - 1e-12 for a, b in zip(order, order[1:]))
        assert abs(sum(got[i, w] ** 2 for w in order) - 1) < 1e-9
    plan = matrix._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # ids are unique: tweets meet by id alone, and terms by themselves
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert sum("hashpartitioning(term" in x for x in exchanges) == (hot == 1)  # with 512 all are frequent
    assert all("hashpartitioning(term" in x or "hashpartitioning(tweet_id" in x for x in exchanges)


def test_frequencies_by_place(spark):
    packed = [(at << vz.DF_BITS) | n for at, n in ((1, 5), (2, 7), (5, 1 << 33))]
    rows = spark.createDataFrame([(packed,), ([],), (None,)], "f array<bigint>")
    assert [r[0] for r in rows.select(vz._by_place("f")).collect()] == [[1, 5, 7, 1, 1, 1 << 33], [], []]


def test_many_unseen_tweets_meet_the_vocabulary_without_being_counted(spark, monkeypatch):
    known = vz.stage_terms(corpus(spark, [(i, ["en", None][i % 2], f"hot w{i % 9}") for i in range(60)]), tk.whitespace_tokens)
    vocabulary = stage(vz.fit_idf(known), "vocabulary")
    rows = [(i, ["en", None, "fr"][i % 3], f"hot never w{i % 12}") for i in range(90)] + [(None, "en", "hot"), (3, "en", "hot")]
    unseen = vz.stage_terms(corpus(spark, rows), tk.whitespace_tokens)

    def entries():
        joined = vz.join_vocabulary(unseen, vocabulary, unseen=True)
        counted = any("/counts-" in f for f in joined.inputFiles())
        return counted, Counter((r.tweet_id, r.lang, r.term, r.df, r.n_docs) for r in joined.collect())

    few = entries()
    monkeypatch.setattr(vz, "HOT_TWEETS", 20)
    found = {}
    for share in (1, 30, 10**9):
        monkeypatch.setattr(vz, "HOT_SHARE", share)
        found[share] = entries()
    assert few[0] and not any(counted for counted, _ in found.values())
    assert all(got == few[1] for _, got in found.values()) and few[1]


@pytest.mark.parametrize("share", [1, 8, 10**9])
def test_numbers_are_turned_back_to_terms(spark, monkeypatch, share):
    monkeypatch.setattr(vz, "HOT_SHARE", share)
    vocabulary = stage(
        spark.createDataFrame(
            [("en", 0, "a", 9), ("en", 1, "b", 1), (None, 0, "c", 4), (None, 1, "d", 1)],
            "lang string, term_id bigint, term string, df bigint",
        ),
        "vocabulary",
    )
    entries = [(1, "en", 0), (1, "en", 1), (2, None, 0), (2, None, 1), (3, "en", 2), (3, "fr", 0), (1, "en", 0), (4, "en", None)]
    rows = spark.createDataFrame(entries, "tweet_id bigint, lang string, term_id bigint")
    got = Counter((r.tweet_id, r.lang, r.term) for r in vz.with_terms(rows, vocabulary).collect())
    assert got == Counter([(1, "en", "a"), (1, "en", "a"), (1, "en", "b"), (2, None, "c"), (2, None, "d")])
