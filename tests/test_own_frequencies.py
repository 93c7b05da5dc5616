import math
from collections import Counter

import pytest

from moodfeed.functions import tokens as tk
from moodfeed.operators import vectorize as vz

ROWS = [
    (1, "en", "aaa bbb aaa"), (2, "en", "aaa ccc"), (2, "en", "aaa ccc"), (3, None, "aaa bbb"), (4, None, "aaa"),
    (None, "de", "ddd aaa"), (5, "de", ""), (6, "de", None), (7, "en", "bbb ccc ddd"),
]


def grams(text):
    words = (text or "").split()
    return set(words) | {" ".join(pair) for pair in zip(words, words[1:])}


@pytest.mark.parametrize(
    "share, tweets", [(512, 20_000), (1, 20_000), (8, 20_000), (512, 1)],
    ids=["all frequent", "none frequent", "some frequent", "few looked at"],
)
def test_frequencies_counted_beside_the_entries(spark, monkeypatch, share, tweets):
    monkeypatch.setattr(vz, "OWN_SHARE", share)
    monkeypatch.setattr(vz, "HOT_TWEETS", tweets)
    corpus = spark.createDataFrame(ROWS, "tweet_id bigint, lang string, corpus string").repartition(3)
    vocabulary, matrix = vz.fit_transform(corpus, tk.whitespace_tokens)
    docs = Counter(lang for _, lang, _ in ROWS)
    df = Counter((lang, term) for _, lang, text in ROWS for term in grams(text))
    idf = {k: math.log((1 + docs[k[0]]) / (1 + n)) + 1 for k, n in df.items()}
    assert {(r.lang, r.term): (r.df, r.n_docs) for r in vocabulary.collect()} == {
        k: (n, docs[k[0]]) for k, n in df.items()
    }
    square = Counter()
    for tweet, lang, text in ROWS:
        for term in grams(text):
            square[tweet] += idf[lang, term] ** 2
    wanted = Counter(
        (tweet, lang, term, round(idf[lang, term] / math.sqrt(square[tweet]), 9))
        for tweet, lang, text in ROWS for term in grams(text)
    )
    assert Counter((r.tweet_id, r.lang, r.term, round(r.tfidf, 9)) for r in matrix.collect()) == wanted


def test_rare_terms_are_left_out(spark):
    corpus = spark.createDataFrame(ROWS, "tweet_id bigint, lang string, corpus string")
    vocabulary, matrix = vz.fit_transform(corpus, tk.whitespace_tokens, min_df=2)
    kept = {(r.lang, r.term) for r in vocabulary.collect()}
    assert kept == {("en", t) for t in ("aaa", "bbb", "ccc", "aaa ccc")} | {(None, "aaa")}
    assert {(r.lang, r.term) for r in matrix.collect()} == kept


def test_no_vocabulary_is_joined_and_no_runs_are_staged(spark):
    corpus = spark.createDataFrame(ROWS, "tweet_id bigint, lang string, corpus string")
    _, matrix = vz.fit_transform(corpus, tk.whitespace_tokens)
    assert not any("/vocabulary-" in f for f in matrix.inputFiles())
    terms = vz.stage_terms(corpus, tk.whitespace_tokens)
    kept = spark.read.parquet(*terms.inputFiles())
    lists = next(c for c, t in kept.dtypes if t == "array<string>")
    assert not any(" " in word for r in kept.collect() for word in r[lists] or [])
    assert any(" " in term for r in terms.collect() for term in r.terms or [])


def test_runs_of_tokens_of_any_width(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "v array<string>")
    got = [r[0] for r in rows.select(tk.ngrams(rows.v, 4)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]
