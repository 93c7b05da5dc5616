import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodfeed.functions import tokens as tk
from moodfeed.operators import learn
from moodfeed.operators import vectorize as vz
from moodfeed.operators.metrics import accuracy, auc_hard, auc_score, macro_scores, report
from moodfeed.operators.process import COUNTS, drop_unlabeled, process
from moodfeed.operators.ranking import split_positional, with_position
from moodfeed.staging import stage
from moodfeed.streaming import jobs

WORDS = {1: ["good", "great", "fine", "nice"], -1: ["bad", "poor", "sad", "ugly"]}


@pytest.fixture(scope="module")
def tweets(spark):
    rows = []
    for i in range(240):
        label = 1 if i % 3 else -1
        words = [WORDS[label][(i + k) % 4] for k in range(2)] + [f"word{i % 7}", "film"]
        if i % 10 == 0:
            words.append("#tag!")
        mark = {1: ":)", -1: ":("}[label] if i % 5 else ""
        rows.append((i, "en" if i % 2 else "de", " ".join(words) + f" {mark}"))
    return stage(
        spark.createDataFrame(rows, "tweet_id bigint, lang string, text string"), "tweets"
    )


@pytest.fixture(scope="module")
def inputs(tweets):
    processed = stage(process(tweets), "processed")
    return processed, *learn.stage_training_inputs(processed)


def gradient(inputs, model):
    """Mean-loss gradient plus penalty, by numpy, per language."""
    processed, terms, vocabulary, moments = inputs
    rows = drop_unlabeled(processed)
    entries = vz.tfidf(terms, vocabulary).toPandas()
    scaled = vz.scale_features(rows, moments).toPandas().set_index("tweet_id")
    labels = rows.toPandas().set_index("tweet_id")
    weights = model.terms.toPandas()
    numeric = model.numeric.toPandas().set_index("lang")
    worst = 0.0
    for lang, own in labels.groupby("lang"):
        w = weights[weights.lang == lang].set_index("term").weight
        x = (
            entries[entries.tweet_id.isin(own.index)]
            .pivot(index="tweet_id", columns="term", values="tfidf")
            .reindex(index=own.index, columns=w.index)
            .fillna(0.0)
        )
        dense = scaled.loc[own.index, COUNTS].to_numpy()
        full = np.hstack([x.to_numpy(), np.ones((len(own), 1)), dense])
        row = numeric.loc[lang]
        coef = np.concatenate([w.to_numpy(), [row[f"{n}_weight"] for n in ["bias", *COUNTS]]])
        y = own.label.to_numpy()
        penalty = coef / len(own)
        penalty[len(w)] = 0.0
        slope = -(y / (1 + np.exp(y * (full @ coef)))) @ full / len(own) + penalty
        worst = max(worst, np.abs(slope).max())
    return worst


def test_gradient_vanishes(inputs):
    processed, terms, vocabulary, moments = inputs
    labeled = drop_unlabeled(processed)
    model = learn.fit(labeled, terms, vocabulary, moments, tol=1e-10, max_iter=500)
    assert gradient(inputs, model) < 1e-4


def test_table_optimizer_agrees(inputs):
    """What exceeds the driver's bound is fitted on tables, to the same minimum."""
    processed, terms, vocabulary, moments = inputs
    labeled = drop_unlabeled(processed).filter(F.col("lang") == "en")
    here = learn.fit(labeled, terms, vocabulary, moments, tol=1e-9, max_iter=300)
    there = learn.fit(
        labeled, terms, vocabulary, moments, tol=1e-7, max_iter=25, solver="tables"
    )
    both = (
        here.terms.select("lang", "term", F.col("weight").alias("a"))
        .join(there.terms.select("lang", "term", F.col("weight").alias("b")), ["lang", "term"])
        .toPandas()
    )
    assert len(both) == here.terms.count()
    assert np.abs(both.a - both.b).max() < 0.02
    a, b = (m.numeric.filter("lang = 'en'").toPandas().iloc[0] for m in (here, there))
    assert all(abs(a[f"{n}_weight"] - b[f"{n}_weight"]) < 0.02 for n in ["bias", *COUNTS])


def test_model_separates_and_survives_storage(spark, inputs, tmp_path):
    processed, terms, vocabulary, moments = inputs
    model = learn.fit(drop_unlabeled(processed), terms, vocabulary, moments)
    scored = learn.score(processed, terms, model)
    got = report(scored.filter(F.col("label").isNotNull())).first()
    assert got.accuracy == 1.0 and got.macro_f1 == 1.0 and got.roc_auc == 1.0
    assert scored.count() == processed.count()
    model.save(str(tmp_path / "model"))
    loaded = learn.SentimentModel.load(spark, str(tmp_path / "model"))
    again = learn.score(processed, terms, loaded)
    a = {r.tweet_id: r.margin for r in scored.collect()}
    b = {r.tweet_id: r.margin for r in again.collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_stream_equals_batch(spark, tweets, inputs, tmp_path):
    processed, terms, vocabulary, moments = inputs
    model = learn.fit(drop_unlabeled(processed), terms, vocabulary, moments)
    source = str(tmp_path / "in")
    tweets.repartition(4).write.parquet(source)
    stream = (
        spark.readStream.schema(tweets.schema).option("maxFilesPerTrigger", 1).parquet(source)
    )
    jobs.score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = {
        r.tweet_id: (round(r.margin, 9), r.prediction)
        for r in spark.read.parquet(str(tmp_path / "out")).collect()
    }
    batch = {
        r.tweet_id: (round(r.margin, 9), r.prediction)
        for r in jobs.score_batch(tweets, model).collect()
    }
    assert streamed == batch and len(batch) == tweets.count()


def test_metrics(spark):
    rows = [(1, 1)] * 5 + [(1, -1)] * 2 + [(-1, -1)] * 3 + [(-1, 1)] * 4
    df = spark.createDataFrame(rows, "label int, prediction int")
    f1 = (2 * 5 / (2 * 5 + 2 + 4) + 2 * 3 / (2 * 3 + 4 + 2)) / 2
    auc = (5 / 7 + 3 / 7) / 2
    got = report(df).first()
    assert (got.n, round(got.accuracy, 9)) == (14, round(8 / 14, 9))
    assert math.isclose(got.macro_f1, f1) and math.isclose(got.roc_auc, auc)
    assert math.isclose(accuracy(df).first()[0], 8 / 14)
    assert math.isclose(macro_scores(df).first().macro_f1, f1)
    assert math.isclose(auc_hard(df).first()[0], auc)
    one_class = df.filter("label = 1")
    assert report(one_class).first().roc_auc is None and auc_hard(one_class).first()[0] is None
    # a class that is only predicted counts, with score 0
    assert math.isclose(report(one_class).first().macro_f1, 10 / 12 / 2)
    assert math.isclose(macro_scores(one_class).first().macro_f1, 10 / 12 / 2)
    all_right = df.filter("label = 1 and prediction = 1")
    assert report(all_right).first().macro_f1 == 1.0


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_positions_and_split(spark, partitions):
    rows = [((i * 7919) % 1000, "ab"[i % 2]) for i in range(1000)]
    df = spark.createDataFrame(rows, "tweet_id bigint, lang string").repartition(partitions)
    numbered = {r.tweet_id: r.position for r in with_position(df, ["tweet_id"]).collect()}
    assert numbered == {i: i for i in range(1000)}
    train, test = split_positional(df, 0.7)
    assert {r.tweet_id for r in train.collect()} == set(range(700)) and test.count() == 300
    train, _ = split_positional(df, 0.7, group="lang")
    got = train.groupBy("lang").agg(F.count("*"), F.max("tweet_id")).collect()
    for lang, n, last in got:
        ids = sorted(i for i, own in rows if own == lang)
        assert n == int(0.7 * len(ids)) and last == ids[n - 1]


def test_no_tweet_is_lost(spark):
    """Without a language, or with one that has no model, the row stays and has no prediction."""
    rows = [(1, "en", "good day"), (2, "it", "bella vita"), (3, None, "some text"), (4, "en", "")]
    tweets = spark.createDataFrame(rows, "tweet_id bigint, lang string, text string")
    processed = stage(process(tweets, tokenizer=tk.whitespace_tokens), "processed")
    terms = vz.stage_terms(processed, tk.whitespace_tokens)
    vocabulary = stage(vz.fit_idf(terms).withColumn("weight", F.lit(1.0)), "vocabulary")
    weights = [F.lit(0.5).alias(f"{n}_weight") for n in ["bias", *vz.COUNTS]]
    numeric = vz.feature_moments(processed).select("*", *weights).filter("lang = 'en'")
    model = learn.SentimentModel(vocabulary, stage(numeric, "numeric"))
    for unseen in (False, True):
        scored = {r.tweet_id: r for r in learn.score(processed, terms, model, unseen).collect()}
        assert set(scored) == {1, 2, 3, 4}
        assert scored[1].prediction in (1, -1) and scored[4].prediction in (1, -1)
        assert scored[2].prediction is scored[2].margin is scored[3].prediction is None
    matrix, labels = vz.feature_matrix(tweets, use_features=True, tokenizer=tk.whitespace_tokens)
    assert matrix.select("tweet_id").distinct().count() == labels.count() == 4


def test_small_batches_do_not_move_the_vocabulary(spark):
    rows = spark.range(50_000).select(
        F.lit("en").alias("lang"), F.concat(F.lit("w"), F.col("id")).alias("term"),
        F.lit(1).cast("bigint").alias("df"), F.lit(1.0).alias("idf"),
    )
    vocabulary = stage(rows, "vocabulary")
    tweets = spark.createDataFrame([(1, "en", ["w1", "w2", "zz"])], "tweet_id bigint, lang string, terms array<string>")
    joined = vz.join_vocabulary(stage(tweets, "terms"), vocabulary, unseen=True)
    assert {r.term for r in joined.collect()} == {"w1", "w2"}
    plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_solvers_are_named(spark):
    empty = spark.createDataFrame([], "tweet_id bigint")
    with pytest.raises(ValueError, match="tables"):
        learn.fit(empty, empty, empty, solver="other")


def test_labelled_experiment_learns(spark):
    """The endings tell the label; one that learns nothing has an AUC of 0.5; some endings have no word to learn from."""
    from moodfeed.queries import experiment_labeled

    row = experiment_labeled(spark, "/root/testdata/sf0.001").first()
    assert row.n > 50 and row.roc_auc > 0.55


def mean_rank_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y != 1]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


def test_score_auc_by_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [
        (lang, float(s), 1 if rng.random() < 0.3 + 0.1 * s else -1)
        for lang in ("en", "fr", None)
        for s in rng.integers(-4, 5, 300)
    ]
    rows += [("de", 1.0, 1), ("de", 2.0, 1), ("es", None, 1), ("es", 0.5, None), ("it", 0.0, -1), ("it", 0.0, 1)]
    df = spark.createDataFrame(rows, "lang string, margin double, label int")
    got = {r.lang: (r.n_positive, r.n_negative, r.roc_auc) for r in auc_score(df, by=["lang"]).collect()}
    assert set(got) == {"en", "fr", None, "de", "it"}
    for lang, (p, n, auc) in got.items():
        own = [(s, y) for c, s, y in rows if c == lang]
        assert (p, n) == (sum(y == 1 for _, y in own), sum(y == -1 for _, y in own))
        assert auc == pytest.approx(mean_rank_auc(own))
    assert got["de"][2] is None and got["it"][2] == 0.5
    known = [(s, y) for _, s, y in rows if s is not None and y is not None]
    assert auc_score(df).first().roc_auc == pytest.approx(mean_rank_auc(known))
    assert auc_score(df.limit(0)).collect()[0].roc_auc is None
    assert auc_score(df.limit(0), by=["lang"]).collect() == []


def test_hot_scores_stay_small(spark):
    """Two scores for all rows: counted before the sort."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(-1).alias("label"), (F.col("id") % 2).cast("double").alias("margin")
    )
    row = auc_score(df).first()
    assert row.n_positive == 6667 and row.roc_auc == pytest.approx(0.5, abs=1e-3)


def test_vectors_hold_what_the_matrix_holds(spark):
    rows = [
        (1, "en", "good film :)"), (2, "en", "good good day!! :("), (3, "fr", "bon film"), (4, None, "no language"),
        (5, "en", ""), (6, "de", "a"), (7, None, "language"),
    ]
    tweets = spark.createDataFrame(rows, "tweet_id bigint, lang string, text string")
    for counts in (False, True):
        vectors, vocabulary = vz.feature_vectors(tweets, counts)
        matrix, labels = vz.feature_matrix(tweets, counts)
        ids = {(r.lang, r.term): r.term_id for r in vocabulary.collect()}
        sizes = {}
        for lang, _ in ids:
            sizes[lang] = sizes.get(lang, 0) + 1
        want = {}
        for r in matrix.collect():
            place = ids.get((r.lang, r.feature))
            if place is None:
                place = sizes.get(r.lang, 0) + COUNTS.index(r.feature)
            want.setdefault(r.tweet_id, {})[place] = r.value
        got = vectors.collect()
        assert sorted(r.tweet_id for r in got) == [r[0] for r in rows]
        for r in got:
            own = dict(zip(r.features.indices.tolist(), r.features.values.tolist()))
            assert own == pytest.approx(want.get(r.tweet_id, {}))
            assert r.features.size == sizes.get(r.lang, 0) + (len(COUNTS) if counts else 0)
        assert {r.tweet_id: r.label for r in got} == {r.tweet_id: r.label for r in labels.collect()}
        plan = vectors._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_experiments_negate_in_the_language_of_the_tweet(spark):
    from moodfeed.plans.experiments import distant_experiment, train_distant

    rows = []
    for i in range(60):
        rows.append((i, "fr", f"pas bon film{i % 5} :(" if i % 2 else f"bon film{i % 5} :)"))
        rows.append((100 + i, "en", f"not good film{i % 5} :(" if i % 2 else f"good film{i % 5} :)"))
    tweets = spark.createDataFrame(rows, "tweet_id bigint, lang string, text string")
    model, _, _ = train_distant(tweets, lang_rules=True)
    weights = {(r.lang, r.term): r.weight for r in model.terms.collect()}
    assert weights["fr", "pas___bon"] < 0 < weights["fr", "bon"]
    assert weights["en", "not___good"] < 0 < weights["en", "good"]
    plain, _, _ = train_distant(tweets)
    assert "pas___bon" not in {r.term for r in plain.terms.collect()}
    assert {r.accuracy for r in distant_experiment(tweets, lang_rules=True).collect()} == {1.0}
    with pytest.raises(ValueError, match="nothing to learn"):
        train_distant(tweets, use_features=False, use_terms=False)


def test_a_small_batch_opens_few_files_of_the_vocabulary(spark, inputs, tmp_path):
    processed, terms, vocabulary, moments = inputs
    model = learn.fit(drop_unlabeled(processed), terms, vocabulary, moments)
    model.save(str(tmp_path / "model"), prefixes=64)
    stored = learn.SentimentModel.load(spark, str(tmp_path / "model"))
    assert stored.prefixes == 64 and stored.terms.count() == model.terms.count()
    batch = [(i, "en", "good film") for i in range(4)] + [(4, "xx", "unknown words"), (5, None, "")]
    few = stage(process(spark.createDataFrame(batch, "tweet_id bigint, lang string, text string")), "processed")
    grams = vz.stage_terms(few)
    counts = vz.document_frequency(grams)
    part = vz.narrowed(stored.terms, counts, 64)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "prefix#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = part.select("_metadata.file_path").distinct().count()
    assert 0 < files <= 7 < stored.terms.select("_metadata.file_path").distinct().count()
    with_folders, without = (
        {r.tweet_id: r.margin for r in learn.score(few, grams, m, unseen=True).collect()} for m in (stored, model)
    )
    assert with_folders == pytest.approx(without)
