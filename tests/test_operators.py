import math
import random

import pytest
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from moodfeed import lexicon as lx
from moodfeed.functions import features as fx
from moodfeed.functions import text as tx
from moodfeed.functions import tokens as tk
from moodfeed.operators import collect as cl
from moodfeed.operators import ranking
from moodfeed.operators import vectorize as vz
from moodfeed.operators.process import process
from moodfeed.sources import fixtures, readers
from moodfeed.staging import fresh_path, scratch, stage

SF = "/root/testdata/sf0.001"


def one(spark, value, column, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(column).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a &amp; b &lt;3", "a & b <3"),
        ("&amp;lt; &amp;amp;", "< &"),
        ("&#39;x&#x27; &eacute;&copy; &apos;", "'x' é© '"),
        ("&unknown; &#0; &; &#99999999; a;b;", "&unknown; &#0; &; &#99999999; a;b;"),
        ("&#128512;", "😀"),
        ("no entity", "no entity"),
    ],
)
def test_unescape(spark, text, expected):
    assert one(spark, text, tx.unescape_html(F.col("v"))) == expected


@pytest.mark.parametrize(
    "tokens, marked, count",
    [
        (["not", "not", "not", "good"], ["", "not___not", "", "not___good"], 2),
        (["not"], ["not"], 1),
        (["a", "not"], ["a", "not"], 1),
        (["not", "@x", "nothing", "not", ":)"], ["", "not___@x", "nothing", "", "not___:)"], 2),
        (["knot", "good"], ["knot", "good"], 0),
        ([], [], 0),
    ],
)
def test_negation(spark, tokens, marked, count):
    v = F.col("v")
    ddl = "v array<string>"
    assert one(spark, tokens, fx.mark_negation(v), ddl) == marked
    assert one(spark, tokens, fx.count_negations(v), ddl) == count


def test_contractions(spark):
    tokens = ["don't", "We've", "word", "a-it’s", "'s", "can’t"]
    got = one(spark, tokens, tk.split_contractions(F.col("v")), "v array<string>")
    assert got == ["do", "n't", "We", "'ve", "word", "it", "’s", "'s", "ca", "n’t"]


def test_ngrams(spark):
    v = F.col("v")
    ddl = "v array<string>"
    assert one(spark, ["a", "b", "c"], tk.ngrams(v, 3), ddl) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, ["a"], tk.ngrams(v, 2), ddl) == ["a"]
    assert one(spark, [], tk.ngrams(v, 2), ddl) == []


def test_options(spark):
    df = spark.createDataFrame([(1, "RT rt cats :-( pas bon")], "tweet_id bigint, text string")
    plain = process(df).first()
    assert plain.label == 1 and plain.token_count == 6
    strict = process(
        df, strict_emoticons=True, retweet_case_insensitive=True, stopwords=lx.stopwords("fr"),
        negation_word="pas",
    ).first()
    assert strict.label == -1 and strict.token_count == 4 and strict.negation_count == 1
    assert strict.corpus == "cats  pas___bon"


def test_country_domains(spark):
    domains = set(lx.COUNTRY_DOMAINS)
    assert {"uk", "eu", "su", "tp", "de", "us"} <= domains and "bq" not in domains
    assert len(domains) == len(lx.COUNTRY_DOMAINS) and all(len(d) == 2 for d in domains)


def test_stopwords_same_without_a_session(spark):
    for lang, name in lx.SPARK_STOPWORD_LISTS.items():
        from pyspark.ml.feature import StopWordsRemover

        full = set(StopWordsRemover.loadDefaultStopWords(name))
        assert full - set(lx.stopwords(lang)) == (
            {"not", "very"} if lang == "en" else {lx.NEGATION_WORDS[lang]}
        )


BACKUP = [
    '{"text": "a :)", "tweet-lang": "en", "timestamp": {"$numberLong": "1735689600123"}}',
    '{"text": "b :)", "tweet-lang": "en"}',
    '{"text": "c :)", "timestamp": {"$numberLong": "1735689600123"}}',
    '{"text": "d", "tweet-lang": "en", "timestamp": {"$numberLong": "1735689600123"}}',
    '{"text": "e :(", "tweet-lang": "en", "timestamp": {"$numberLong": "946684800000"}}',
    '{"text": "f :(", "tweet-lang": "fr", "timestamp": {"$numberLong": "1735689600123"}}',
    '{"text": "g x:) :D", "tweet-lang": "en", "timestamp": {"$numberLong": "1704067200000"}}',
]


def test_collect(spark, tmp_path):
    path = tmp_path / "backup.json"
    path.write_text("\n".join(BACKUP))
    rows = readers.read_backup(spark, str(path))
    texts = {r.text for r in cl.collect_tweets(rows, "en", 2025).collect()}
    assert texts == {"a :)", "g x:) :D"}
    assert cl.collect_tweets(rows, "en", 2025, 1).count() == 1
    assert cl.collect_tweets(rows, 9, 2025).count() == 0


def test_limit_is_cut_by_position(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("tweet_id")).repartition(7)
    got = [r.tweet_id for r in cl.first_rows(df, 300).collect()]
    assert sorted(got) == list(range(300))


def test_polarity_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(
        '"4","1","Mon","NO_QUERY","u","say ""hi"", ok"\n"0","2","Mon","NO_QUERY","u","bad"\n'
        '"2","3","Mon","NO_QUERY","u","so so"\n'
    )
    got = cl.polarity_labels(readers.read_polarity(spark, str(path))).collect()
    assert {tuple(r) for r in got} == {(1, 1, 'say "hi", ok'), (2, -1, "bad")}


def corpus(spark, rows):
    return spark.createDataFrame(rows, "tweet_id bigint, lang string, corpus string")


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_tfidf_by_hand(spark, partitions):
    df = corpus(spark, [(1, "en", "aaa bbb"), (2, "en", "aaa"), (3, "en", ""), (4, "de", "aaa")])
    vocabulary, matrix = vz.fit_transform(df.repartition(partitions), tk.whitespace_tokens)
    common, rare = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    idf = {(r.lang, r.term): (r.df, r.n_docs, r.idf) for r in vocabulary.collect()}
    assert idf.keys() == {("en", "aaa"), ("en", "bbb"), ("en", "aaa bbb"), ("de", "aaa")}
    assert idf["en", "aaa"][:2] == (2, 3) and math.isclose(idf["en", "aaa"][2], common)
    norm = math.sqrt(common**2 + 2 * rare**2)
    got = {(r.tweet_id, r.term): r.tfidf for r in matrix.collect()}
    assert got.keys() == {(1, "aaa"), (1, "bbb"), (1, "aaa bbb"), (2, "aaa"), (4, "aaa")}
    assert math.isclose(got[1, "bbb"], rare / norm) and math.isclose(got[2, "aaa"], 1.0)


def test_tfidf_equals_mllib(spark):
    tweets = fixtures.tweets(spark, SF).filter("lang = 'fr'").drop("ts_ms")
    processed = stage(process(tweets), "processed")
    terms = vz.stage_terms(processed)
    vocabulary = stage(vz.fit_vocabulary(terms), "vocabulary")
    rows = sorted(vocabulary.collect(), key=lambda r: r.term_id)
    assert [r.term for r in rows] == sorted(r.term for r in rows)
    model = CountVectorizerModel.from_vocabulary(
        [r.term for r in rows], inputCol="terms", outputCol="tf"
    ).setBinary(True)
    idf = ElementwiseProduct(
        scalingVec=Vectors.dense([r.idf for r in rows]), inputCol="tf", outputCol="weighted"
    )
    unit = Normalizer(p=2.0, inputCol="weighted", outputCol="v")
    theirs = {}
    for r in unit.transform(idf.transform(model.transform(terms))).select("tweet_id", "v").collect():
        for i, x in zip(r.v.indices, r.v.values):
            theirs[r.tweet_id, int(i)] = x
    ours = {(r.tweet_id, r.term_id): r.tfidf for r in vz.tfidf(terms, vocabulary).collect()}
    assert ours.keys() == theirs.keys()
    assert max(abs(ours[k] - theirs[k]) for k in ours) < 1e-9


def test_hot_terms_and_unseen_tweets(spark, monkeypatch):
    """Half of all postings are one term; every hot share must give the same matrix."""
    rows = [(i, "en", f"hot w{i % 50} x{i}") for i in range(400)]
    terms = vz.stage_terms(corpus(spark, rows), tk.whitespace_tokens, 1)
    vocabulary = stage(vz.fit_idf(terms), "vocabulary")
    new = [(i, "en", f"hot never w{i % 7}") for i in range(200)]
    unseen = vz.stage_terms(corpus(spark, new), tk.whitespace_tokens, 1)
    results = []
    for share in (1, 4, 10**9):
        monkeypatch.setattr(vz, "HOT_SHARE", share)
        results.append(
            (
                sorted((*r[:3], round(r[3], 9)) for r in vz.tfidf(terms, vocabulary).collect()),
                sorted((*r[:3], round(r[3], 9)) for r in vz.tfidf(unseen, vocabulary, True).collect()),
            )
        )
    assert results[0] == results[1] == results[2]
    assert len(results[0][0]) == 1200 and len(results[0][1]) == 400


def test_scaling(spark):
    rows = [(i, "en", i, 0, 1, 2, i % 2, 5) for i in range(10)]
    columns = ", ".join(f"{c} int" for c in vz.COUNTS)
    df = stage(
        spark.createDataFrame(rows, f"tweet_id bigint, lang string, {columns}"), "features"
    )
    got = {r.tweet_id: r for r in vz.scale_features(df).collect()}
    assert math.isclose(got[0].rep_count, -4.5 / math.sqrt(8.25))
    assert got[3].hashtag_count == 0 and got[3].token_count == 0
    moments = stage(vz.feature_moments(df), "moments")
    single = vz.scale_features(df.filter("tweet_id = 9"), moments).first()
    assert math.isclose(single.rep_count, 4.5 / math.sqrt(8.25))


def test_feature_matrix_and_clearing(spark):
    rows = [(1, "en", "good film :)"), (2, "en", "film"), (3, "en", "bad film :(")]
    tweets = spark.createDataFrame(rows, "tweet_id bigint, lang string, text string")
    matrix, labels = vz.feature_matrix(tweets, use_features=True)
    assert matrix.filter("feature = 'token_count'").count() == 3
    matrix, labels = vz.clear_unlabeled(matrix, labels)
    assert {r.tweet_id for r in labels.collect()} == {1, 3}
    assert {r.tweet_id for r in matrix.select("tweet_id").distinct().collect()} == {1, 3}


def test_properties_of_fixture(spark):
    tweets = fixtures.tweets(spark, SF)
    processed = stage(process(tweets), "processed")
    assert processed.count() == tweets.count()
    bad = processed.filter(
        "token_count < hashtag_count + exclam_count + question_count or label not in (1, -1)"
    )
    assert bad.count() == 0
    twice = tx.truncate_elongations(tx.truncate_elongations(F.col("text")))
    changed = tweets.filter(twice != tx.truncate_elongations(F.col("text")))
    assert changed.count() == 0
    _, matrix = vz.fit_transform(processed)
    norms = matrix.groupBy("tweet_id").agg(F.sum(F.col("tfidf") ** 2).alias("s"))
    assert norms.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_scratch_is_deleted(spark):
    with scratch(spark):
        path = fresh_path(spark, "x")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not fs.exists(hadoop)


def test_rules_of_each_language(spark):
    rows = [
        (1, "fr", "c'est pas bon"), (2, "de", "das ist nicht gut"), (3, "es", "no bueno"),
        (4, "en", "it is not good"), (5, "it", "this is not good"), (6, None, "this is not good"),
        (7, "fr", "not good"),
    ]
    tweets = spark.createDataFrame(rows, "tweet_id bigint, lang string, text string")
    done = process(tweets, tokenizer=tk.whitespace_tokens, lang_rules=True).collect()
    corpus = {r.tweet_id: r.corpus.split() for r in done}
    assert "pas___bon" in corpus[1] and "nicht___gut" in corpus[2] and "no___bueno" in corpus[3]
    assert corpus[4] == corpus[5] == corpus[6] == ["not___good"]
    assert {r.tweet_id: r.negation_count for r in done} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0}


def test_ids_of_two_loads_stay_apart(spark, tmp_path):
    frames = []
    for name in ("monday", "tuesday"):
        path = tmp_path / f"{name}.json"
        path.write_text("\n".join(BACKUP * 3))
        frames.append(readers.read_backup(spark, str(path)))
    both = frames[0].unionByName(frames[1])
    assert both.select("tweet_id").distinct().count() == both.count() == 6 * len(BACKUP)
    numbered = tmp_path / "numbered.json"
    numbered.write_text('{"id": 7, "text": "a"}\n{"id": 9, "text": "b"}')
    found = readers.read_backup(spark, str(numbered), id_field="id")
    assert {r.tweet_id: r.text for r in found.collect()} == {7: "a", 9: "b"}


def test_smallest_rows_by_histograms(spark, monkeypatch):

    rnd = random.Random(4)
    wide = [(rnd.randint(-(2**63), 2**63 - 1), "x") for _ in range(300)]
    wide += [(-(2**63), "a"), (2**63 - 1, "b")]
    tied = [(7, f"t{i:03d}") for i in range(120)] + [(i, "y") for i in range(20)] + [(None, f"n{i}") for i in range(5)]
    monkeypatch.setattr(ranking, "CELLS", 4)
    monkeypatch.setattr(ranking, "SORTED", 10)
    for rows in (wide, tied, [(1, "a")] * 30, []):
        df = spark.createDataFrame(rows, "tweet_id bigint, text string").repartition(5)
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for n in (0, 1, 3, 5, 6, 17, 60, 139, 145, 1000):
            got = [tuple(r) for r in cl.first_rows(df, n).collect()]
            assert sorted(got, key=str) == sorted(ordered[:n], key=str), n


def test_limit_neither_sorts_nor_copies_the_table(spark):

    rows = spark.range(100_000).select((F.col("id") * 977 % 100_003).alias("tweet_id"), F.lit("t").alias("text"))
    cut = cl.first_rows(rows, 49_987)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "FileScan" not in plan
    assert "TakeOrderedAndProject" in plan
    assert cut.count() == 49_987 and cut.agg(F.max("tweet_id")).first()[0] < 50_010


def test_backup_ids_do_not_depend_on_splits(spark, tmp_path):
    """Two ways to split the files and two loads: the same ids, one for each row, equal rows too."""
    lines = [f'{{"text": "t{i % 50}", "tweet-lang": "en"}}' for i in range(3000)]
    lines += ['{"text": "same", "tweet-lang": "fr"}'] * 2500 + ['{"text": "", "tweet-lang": "fr"}', '{"tweet-lang": "fr"}']
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")

    def ids():
        rows = readers.read_backup(spark, str(tmp_path)).collect()
        return sorted((r.tweet_id, r.lang, r.text or "", r.text is None) for r in rows)

    found = ids()
    assert len({r[0] for r in found}) == len(found) == 2 * len(lines)
    assert all(len(r[0]) == 32 for r in found)
    assert ids() == found
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert ids() == found
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_corpus_with_text_ids(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"text": "x :)", "tweet-lang": "en"}\n')
    rows = readers.read_backup(spark, str(tmp_path / "a.json"))
    readers.write_corpus(rows, str(tmp_path / "corpus"))
    back = readers.read_corpus(spark, str(tmp_path / "corpus"), id_type="string")
    assert back.first().tweet_id == rows.first().tweet_id
    assert cl.first_rows(back, 1).count() == 1
