"""The registered queries: every operator over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodfeed import lexicon as lx
from moodfeed.functions import features as fx
from moodfeed.functions import text as tx
from moodfeed.functions import tokens as tk
from moodfeed.operators import collect as cl
from moodfeed.operators import learn, metrics
from moodfeed.operators import vectorize as vz
from moodfeed.operators.joins import null_safe_join
from moodfeed.operators.process import COUNTS, drop_unlabeled, entities, process
from moodfeed.operators.ranking import split_positional
from moodfeed.plans import experiments
from moodfeed.sources import fixtures, readers
from moodfeed.staging import fresh_path, stage
from moodfeed.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

COLLECT_LANG = "en"
COLLECT_LIMIT = 500


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def rounded(name: str) -> Column:
    """To six places, and without a sign on zero."""
    return (F.round(name, 6) + F.lit(0.0)).alias(name)


# --- inputs -----------------------------------------------------------------


def _tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.tweets(spark, sf_dir)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_backup(fixtures.backup_json(_tweets(spark, sf_dir)))


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case texts without elongations."""
    text = tx.truncate_elongations(F.lower("text")).alias("text")
    return _tweets(spark, sf_dir).select("tweet_id", "lang", text)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space tokens without noise."""
    tokens = tk.drop_noise(F.col("tokens"), lx.stopwords()).alias("tokens")
    split = _normal(spark, sf_dir).select(
        "tweet_id", tk.whitespace_tokens(F.col("text")).alias("tokens")
    )
    return split.select("tweet_id", tokens)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select(
        "tweet_id", F.explode(F.array(fx.mark_negation(F.col("tokens")))).alias("tokens")
    )


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(_tweets(spark, sf_dir).drop("ts_ms"), tokenizer=tk.whitespace_tokens)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vz.tweet_terms(_processed(spark, sf_dir), tk.whitespace_tokens)


def _staged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vz.stage_terms(_processed(spark, sf_dir), tk.whitespace_tokens)


def _joined(df: DataFrame, separator: str = " ") -> DataFrame:
    """Lists as text, so that both engines compare the same type."""
    return df.select("tweet_id", F.array_join("tokens", separator).alias("tokens"))


# --- sources and sinks ------------------------------------------------------


def read_backup_json(spark, sf_dir):
    path = fresh_path(spark, "backup")
    fixtures.backup_json(_tweets(spark, sf_dir)).select("json").write.text(path)
    return readers.read_backup(spark, path).select("lang", "text", big("ts_ms"))


def read_polarity_csv(spark, sf_dir):
    path = fresh_path(spark, "polarity")
    fixtures.polarity_lines(_tweets(spark, sf_dir)).select("line").write.text(path)
    return readers.read_polarity(spark, path).select("tweet_id", big("target"), "text")


def corpus_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "corpus")
    readers.write_corpus(_tweets(spark, sf_dir), path)
    return readers.read_corpus(spark, path).select("tweet_id", "lang", "text")


def vocab_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "vocabulary")
    readers.write_vocabulary(vz.fit_vocabulary(_staged_terms(spark, sf_dir)), path)
    stored = readers.read_vocabulary(spark, path)
    return stored.select("lang", "term", big("term_id"), big("df"), big("n_docs"), rounded("idf"))


def tfidf_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "matrix")
    readers.write_matrix(tfidf_fit_transform(spark, sf_dir), path)
    return readers.read_matrix(spark, path)


# --- collector --------------------------------------------------------------


def collect_lang_filter(spark, sf_dir):
    return cl.in_language(_parsed(spark, sf_dir), COLLECT_LANG).select("tweet_id", "lang")


def collect_emoticon_filter(spark, sf_dir):
    return cl.with_emoticon(_tweets(spark, sf_dir)).select("tweet_id", "text")


def collect_timestamp(spark, sf_dir):
    posted = cl.posted_at(F.col("ts_ms"))
    return _parsed(spark, sf_dir).select(
        "tweet_id", F.date_format(posted, "yyyy-MM-dd HH:mm:ss").alias("posted_at")
    )


def collect_year_window(spark, sf_dir):
    timed = _parsed(spark, sf_dir).withColumn("posted_at", cl.posted_at(F.col("ts_ms")))
    return cl.within_years(timed, fixtures.AS_OF_YEAR).select(
        "tweet_id", F.year("posted_at").cast("bigint").alias("year")
    )


def collect_limit(spark, sf_dir):
    return cl.first_rows(_tweets(spark, sf_dir), COLLECT_LIMIT).select("tweet_id", "text")


def collect_tweets(spark, sf_dir):
    return cl.collect_tweets(
        _parsed(spark, sf_dir), COLLECT_LANG, fixtures.AS_OF_YEAR, COLLECT_LIMIT
    )


def collect_all_tweets(spark, sf_dir):
    return cl.collect_tweets(_parsed(spark, sf_dir), COLLECT_LANG, fixtures.AS_OF_YEAR)


def polarity_labels(spark, sf_dir):
    rows = readers.parse_polarity(fixtures.polarity_lines(_tweets(spark, sf_dir)))
    return cl.polarity_labels(rows).select("tweet_id", big("label"), "text")


# --- normalisation and tokens -----------------------------------------------


def elongation(spark, sf_dir):
    low = _tweets(spark, sf_dir).select("tweet_id", F.lower("text").alias("text"))
    return low.select(
        "tweet_id",
        tx.truncate_elongations(F.col("text")).alias("text"),
        tx.count_elongations(F.col("text")).cast("bigint").alias("rep_count"),
    )


def squeeze_whitespace(spark, sf_dir):
    padded = F.concat(F.lit("\t "), F.replace("text", F.lit(" "), F.lit("   \n")))
    return _tweets(spark, sf_dir).select(
        "tweet_id", tx.squeeze_whitespace(padded).alias("text")
    )


def split_edge_punct(spark, sf_dir):
    return _normal(spark, sf_dir).select(
        "tweet_id", tx.split_edge_punctuation(F.col("text")).alias("text")
    )


def tokenize_twitter(spark, sf_dir):
    """No character but white space is lost, and each cut of the text is a token border."""
    df = _normal(spark, sf_dir).select(
        "tweet_id", tk.twitter_tokens(F.col("text")).alias("tokens")
    )
    return _joined(df, "")


def tokenize_twitter_tokens(spark, sf_dir):
    df = _normal(spark, sf_dir).select(
        "tweet_id", tk.twitter_tokens(F.col("text")).alias("tokens")
    )
    return _joined(df)


def tokenize_raw(spark, sf_dir):
    escaped = F.col("text")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(entity))
    df = _tweets(spark, sf_dir).select(
        "tweet_id", tk.raw_twitter_tokens(escaped).alias("tokens")
    )
    return _joined(df, "")


def split_contractions(spark, sf_dir):
    """Every white-space token with an ending appended in turn."""
    endings = F.array(*[F.lit(e) for e in ("", "n't", "'ve", "'ll", "'d", "'re", "'s", "'m")])
    split = _normal(spark, sf_dir).select(
        "tweet_id", tk.whitespace_tokens(F.col("text")).alias("tokens")
    )
    extended = F.transform(
        "tokens", lambda t, i: F.concat(t, F.get(endings, (i % 8).cast("int")))
    ).alias("tokens")
    return _joined(
        split.select("tweet_id", extended).select(
            "tweet_id", tk.split_contractions(F.col("tokens")).alias("tokens")
        )
    )


def entity_counts(spark, sf_dir):
    found = entities(_tweets(spark, sf_dir).select("tweet_id", "text"))
    return found.groupBy(F.coalesce("kind", F.lit("word")).alias("kind")).agg(
        F.count("*").alias("n")
    )


# kinds that a shape between spaces tells
SHAPED_KINDS = ["url", "email", "time", "number", "hashtag", "mention"]


def entity_tokens(spark, sf_dir):
    found = entities(_tweets(spark, sf_dir).select("tweet_id", "text"))
    wanted = found.filter(F.col("kind").isin(SHAPED_KINDS))
    return wanted.groupBy("kind", "token").agg(F.count("*").alias("n"))


def hashtag_mention_counts(spark, sf_dir):
    found = entities(_tweets(spark, sf_dir).select("tweet_id", "text"))
    wanted = found.filter(F.col("kind").isin("hashtag", "mention"))
    return wanted.groupBy("kind", "token").agg(F.count("*").alias("n"))


def stopword_filter(spark, sf_dir):
    return _joined(_kept(spark, sf_dir))


def retweet_filter(spark, sf_dir):
    """The intended, case-insensitive form; with lower-cased texts the other drops nothing."""
    split = _normal(spark, sf_dir).select(
        "tweet_id", tk.whitespace_tokens(F.col("text")).alias("tokens")
    )
    kept = tk.drop_noise(F.col("tokens"), [], retweet_case_insensitive=True).alias("tokens")
    return _joined(split.select("tweet_id", kept))


def tokenize_whitespace(spark, sf_dir):
    return _joined(
        _tweets(spark, sf_dir).select(
            "tweet_id", tk.whitespace_tokens(F.col("text")).alias("tokens")
        )
    )


# --- features, label, corpus ------------------------------------------------


def negation_scope(spark, sf_dir):
    return _joined(_marked(spark, sf_dir))


def negation_count(spark, sf_dir):
    return _kept(spark, sf_dir).select(
        "tweet_id", fx.count_negations(F.col("tokens")).cast("bigint").alias("negation_count")
    )


def mention_normalize(spark, sf_dir):
    return _joined(
        _marked(spark, sf_dir).select(
            "tweet_id", fx.normalize_mentions(F.col("tokens")).alias("tokens")
        )
    )


def url_normalize(spark, sf_dir):
    return _joined(
        _marked(spark, sf_dir).select(
            "tweet_id", fx.normalize_urls(F.col("tokens")).alias("tokens")
        )
    )


def _count_query(prefix: str, name: str) -> Query:
    def query(spark, sf_dir):
        count = fx.count_starting(F.col("tokens"), prefix).cast("bigint")
        return _marked(spark, sf_dir).select("tweet_id", count.alias(name))

    return query


def token_count(spark, sf_dir):
    return _marked(spark, sf_dir).select(
        "tweet_id", F.size("tokens").cast("bigint").alias("token_count")
    )


def emoticon_label(spark, sf_dir):
    return _marked(spark, sf_dir).select(
        "tweet_id", fx.emoticon_label(F.col("tokens")).cast("bigint").alias("label")
    )


def distant_label_counts(spark, sf_dir):
    return _processed(spark, sf_dir).groupBy("lang", big("label")).agg(F.count("*").alias("n"))


def corpus_normalize(spark, sf_dir):
    tokens = fx.normalize_references(F.col("tokens"))
    return _marked(spark, sf_dir).select("tweet_id", fx.corpus_string(tokens).alias("corpus"))


def process_tweets(spark, sf_dir):
    return _wide(_processed(spark, sf_dir))


def process_tweets_by_language(spark, sf_dir):
    """Stopwords and negation of each language; the tweets negate in their own one."""
    word = tk.by_language(F.col("lang"), lambda code: F.lit(" " + lx.NEGATION_WORDS[code]))
    tweets = _parsed(spark, sf_dir).select(
        "tweet_id", "lang", F.replace("text", F.lit(" not"), word).alias("text")
    )
    return _wide(process(tweets, tokenizer=tk.whitespace_tokens, lang_rules=True))


def process_tweets_twitter(spark, sf_dir):
    return _wide(process(_tweets(spark, sf_dir).drop("ts_ms")))


def _wide(processed: DataFrame) -> DataFrame:
    return processed.select("tweet_id", "lang", "corpus", *[big(c) for c in COUNTS], big("label"))


# --- vectors ----------------------------------------------------------------


def ngrams(spark, sf_dir):
    split = _processed(spark, sf_dir).select(
        "tweet_id", tk.whitespace_tokens(F.col("corpus")).alias("tokens")
    )
    grams = split.select("tweet_id", F.explode_outer(tk.ngrams(F.col("tokens"))).alias("term"))
    return grams.filter(F.col("term").isNotNull())


def document_frequency(spark, sf_dir):
    return vz.document_frequency(_terms(spark, sf_dir))


def idf_fit(spark, sf_dir):
    """One vocabulary for all rows."""
    terms = vz.stage_terms(
        _processed(spark, sf_dir).withColumn("lang", F.lit("all")), tk.whitespace_tokens
    )
    fitted = vz.fit_vocabulary(terms)
    return fitted.select("term", big("term_id"), big("df"), big("n_docs"), rounded("idf"))


def idf_per_language(spark, sf_dir):
    fitted = vz.fit_vocabulary(_staged_terms(spark, sf_dir))
    return fitted.select("lang", "term", big("term_id"), big("df"), big("n_docs"), rounded("idf"))


def tfidf_fit_transform(spark, sf_dir):
    _, matrix = vz.fit_transform(_processed(spark, sf_dir), tk.whitespace_tokens)
    return matrix.select("tweet_id", "term", rounded("tfidf"))


def tfidf_transform(spark, sf_dir):
    """Vocabulary of the documents' tweets, applied to the unseen turns of the conversations."""
    vocabulary = stage(vz.fit_idf(_staged_terms(spark, sf_dir)), "vocabulary")
    unseen = vz.stage_terms(
        process(_turns(spark, sf_dir), tokenizer=tk.whitespace_tokens), tk.whitespace_tokens
    )
    matrix = vz.tfidf(unseen, vocabulary, unseen=True)
    return matrix.select("tweet_id", "term", rounded("tfidf"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("tweet_id"),
        F.lit("en").alias("lang"),
        "text",
    )


def scale_features(spark, sf_dir):
    processed = stage(_processed(spark, sf_dir).select("tweet_id", "lang", *COUNTS), "processed")
    scaled = vz.scale_features(processed)
    return scaled.select("tweet_id", *[rounded(c) for c in COUNTS])


def _matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tweets = _tweets(spark, sf_dir).drop("ts_ms")
    return vz.feature_matrix(tweets, use_features=True, tokenizer=tk.whitespace_tokens)


def feature_matrix(spark, sf_dir):
    matrix, _ = _matrix(spark, sf_dir)
    return matrix.select("tweet_id", "feature", rounded("value"))


def feature_matrix_all_languages(spark, sf_dir):
    """The same over the backup, a part of which has no language."""
    tweets = _parsed(spark, sf_dir).drop("ts_ms")
    matrix, _ = vz.feature_matrix(tweets, use_features=True, tokenizer=tk.whitespace_tokens)
    return matrix.select("tweet_id", "feature", rounded("value"))


def feature_vectors_all_languages(spark, sf_dir):
    """The same as vectors, turned back to a row per entry."""
    tweets = _parsed(spark, sf_dir).drop("ts_ms")
    vectors, vocabulary = vz.feature_vectors(tweets, use_features=True, tokenizer=tk.whitespace_tokens)
    entries = null_safe_join(vz.vector_entries(vectors), vz.vocabulary_sizes(vocabulary), ["lang"], "left")
    place = F.col("index") - F.coalesce("n_terms", F.lit(0))
    names = F.array(*[F.lit(c) for c in COUNTS])
    numbered = entries.select(
        "tweet_id", "lang", F.when(place < 0, F.col("index")).cast("long").alias("term_id"),
        F.get(names, place.cast("int")).alias("count"), "value",
    )
    of_terms = vz.with_terms(numbered.where("count IS NULL"), vocabulary)
    return of_terms.select("tweet_id", F.col("term").alias("feature"), rounded("value")).unionByName(
        numbered.where("count IS NOT NULL").select(
            "tweet_id", F.col("count").alias("feature"), rounded("value")
        )
    )


def clear_unlabeled(spark, sf_dir):
    matrix, labels = vz.clear_unlabeled(*_matrix(spark, sf_dir))
    sums = matrix.groupBy("tweet_id").agg(F.count("*").alias("n_entries"))
    return labels.join(sums, "tweet_id").select("tweet_id", big("label"), "n_entries")


# --- learning and evaluation ------------------------------------------------


def split_positional_query(spark, sf_dir):
    labeled = drop_unlabeled(_processed(spark, sf_dir)).select("tweet_id", big("label"))
    train, test = split_positional(stage(labeled, "labeled"))
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


def _distant_model(spark: SparkSession, sf_dir: str):
    return experiments.train_distant(_tweets(spark, sf_dir).drop("ts_ms"))


def lr_fit(spark, sf_dir):
    model, _, _ = _distant_model(spark, sf_dir)
    return model.terms.select("lang", "term", rounded("weight"))


def lr_predict(spark, sf_dir):
    model, test, terms = _distant_model(spark, sf_dir)
    scored = learn.score(test, terms, model)
    return scored.select("tweet_id", big("label"), big("prediction"), rounded("probability"))


def _counts_model(spark: SparkSession, sf_dir: str):
    """A classifier on the six counts alone, run until nothing is gained any more."""
    return experiments.train_distant(
        _tweets(spark, sf_dir).drop("ts_ms"), tokenizer=tk.whitespace_tokens, use_terms=False,
        lang_rules=True, solver={"max_iter": 500, "tol": 1e-9},
    )


def lr_fit_counts(spark, sf_dir):
    model, _, _ = _counts_model(spark, sf_dir)
    inputs = [learn.BIAS, *COUNTS]
    weights = model.numeric.select("lang", *[F.col(f"{c}_weight").alias(c) for c in inputs])
    long = weights.unpivot(["lang"], inputs, "input", "weight")
    return long.select("lang", "input", (F.round("weight", 3) + 0.0).alias("weight"))


def _counts_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test, terms = _counts_model(spark, sf_dir)
    return learn.score(test, terms, model)


def lr_predict_counts(spark, sf_dir):
    scored = _counts_scored(spark, sf_dir)
    return scored.select(
        "tweet_id", "lang", big("label"), (F.round("margin", 2) + 0.0).alias("margin"),
        F.round("probability", 3).alias("probability"), big("prediction"),
    )


def experiment_counts(spark, sf_dir):
    """The distant experiment on the counts, by the rules of each language, with the area under the curve of
    the margins as well as that of the classes."""
    scored = stage(_counts_scored(spark, sf_dir), "scored")
    curve = metrics.auc_score(
        scored.select("lang", "label", F.round("margin", 6).alias("margin")), by=["lang"]
    )
    report = metrics.report(scored, by=["lang"])
    return _all_rounded(
        report.join(curve.select("lang", F.col("roc_auc").alias("roc_auc_score")), "lang")
    )


def generated_weight(term: Column) -> Column:
    return (F.length(term) % 5 - 2) / 10


def linear_score(spark, sf_dir):
    """Stored weights, here generated from the term, applied to every tweet."""
    processed = stage(_processed(spark, sf_dir), "processed")
    terms = vz.stage_terms(processed, tk.whitespace_tokens)
    weighted = stage(
        vz.fit_idf(terms).withColumn("weight", generated_weight(F.col("term"))), "weighted"
    )
    margins = learn.term_margins(terms, weighted)
    scored = learn.with_prediction(margins.withColumnRenamed("term_margin", "margin"))
    return scored.select("tweet_id", rounded("margin"), rounded("probability"))


MODELLED = ["en", "fr"]


def _generated_numeric(processed: DataFrame) -> DataFrame:
    weights = [F.lit(0.1).alias("bias_weight")] + [
        F.lit((k - 2) / 10).alias(f"{name}_weight") for k, name in enumerate(COUNTS)
    ]
    return vz.feature_moments(processed).select("*", *weights)


def _scored_all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets = _parsed(spark, sf_dir).drop("ts_ms")
    processed = stage(process(tweets, tokenizer=tk.whitespace_tokens), "processed")
    terms = vz.stage_terms(processed, tk.whitespace_tokens)
    weighted = stage(
        vz.fit_idf(terms).withColumn("weight", generated_weight(F.col("term"))), "weighted"
    )
    numeric = _generated_numeric(processed).filter(F.col("lang").isin(MODELLED))
    model = learn.SentimentModel(weighted, stage(numeric, "numeric"))
    return learn.score(processed, terms, model)


def score_all_languages(spark, sf_dir):
    """Every tweet of the backup keeps its row, those without a language or a model for it too."""
    return _scored_all_languages(spark, sf_dir).select(
        "tweet_id", "lang", rounded("margin"), rounded("probability"), big("prediction")
    )


def lr_gradient(spark, sf_dir):
    """Largest component of each language's gradient at the fitted weights."""
    tweets = _tweets(spark, sf_dir).drop("ts_ms")
    processed = stage(process(tweets, tokenizer=tk.whitespace_tokens), "processed")
    train, _ = (
        stage(p, "split") for p in split_positional(drop_unlabeled(processed), group="lang")
    )
    terms, vocabulary, moments = learn.stage_training_inputs(processed, tk.whitespace_tokens)
    # run until nothing is gained any more
    model = learn.fit(train, terms, vocabulary, moments, max_iter=1000, tol=1e-10)
    slopes = learn.gradient(model, train, terms)
    largest = slopes.groupBy("lang").agg(F.max(F.abs("slope")).alias("largest"))
    return largest.select("lang", (F.round("largest", 3) + 0.0).alias("largest"))


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))


def _all_rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def metric_accuracy(spark, sf_dir):
    return _all_rounded(metrics.accuracy(_ratings(spark, sf_dir)))


def metric_macro_f1(spark, sf_dir):
    return _all_rounded(metrics.macro_scores(_ratings(spark, sf_dir)))


def metric_auc_hard(spark, sf_dir):
    return _all_rounded(metrics.auc_hard(_ratings(spark, sf_dir)))


def metric_auc_score(spark, sf_dir):
    """Emoticon labels against margins of generated weights; the languages without a model have none."""
    scored = _scored_all_languages(spark, sf_dir).select("lang", "label", rounded("margin"))
    return _all_rounded(metrics.auc_score(scored, by=["lang"]))


def metric_report(spark, sf_dir):
    return _all_rounded(metrics.report(_ratings(spark, sf_dir)))


def experiment_labeled(spark, sf_dir):
    """Train on the documents' tweets, test on the turns of the conversations, both with the endings
    that carry an opinion; the label is that of the ending's emoticon."""

    def labeled(tweets: DataFrame) -> DataFrame:
        label = fx.emoticon_label(tk.whitespace_tokens(F.lower("text")))
        rows = tweets.select("tweet_id", F.lit("en").alias("lang"), label.alias("label"), "text")
        return rows.filter(F.col("label").isNotNull())

    endings = F.array(*[F.lit(d) for d in fixtures.DECORATIONS])
    ending = F.get(endings, (F.col("tweet_id") % len(fixtures.DECORATIONS)).cast("int"))
    turns = _turns(spark, sf_dir).withColumn("text", F.concat("text", ending))
    report = experiments.labeled_experiment(
        labeled(_tweets(spark, sf_dir)), labeled(turns), lang_rules=True
    )
    return _all_rounded(report)


def experiment_distant(spark, sf_dir):
    path = fresh_path(spark, "corpus")
    readers.write_corpus(_tweets(spark, sf_dir), path)
    return _all_rounded(experiments.distant_experiment(readers.read_corpus(spark, path), lang_rules=True))


# --- streams ----------------------------------------------------------------


def stream_collect(spark, sf_dir):
    source, sink = fresh_path(spark, "backup"), fresh_path(spark, "collected")
    fixtures.backup_json(_tweets(spark, sf_dir)).select("json").write.text(source)
    rows = jobs.read_backup_stream(spark, source, id_field="id")
    jobs.collect_stream(
        rows, COLLECT_LANG, fixtures.AS_OF_YEAR, sink, fresh_path(spark, "offsets")
    ).awaitTermination()
    return spark.read.schema("tweet_id bigint, lang string, text string").parquet(sink)


def stream_score(spark, sf_dir):
    """The documents as a stream, scored with generated weights for terms and counts."""
    processed = stage(_processed(spark, sf_dir), "processed")
    terms = vz.stage_terms(processed, tk.whitespace_tokens)
    weighted = stage(
        vz.fit_idf(terms).withColumn("weight", generated_weight(F.col("term"))), "weighted"
    )
    numeric = stage(_generated_numeric(processed), "numeric")
    documents = fixtures.document_stream(spark, sf_dir)
    sink, stored = fresh_path(spark, "scored"), fresh_path(spark, "model")
    learn.SentimentModel(weighted, numeric).save(stored)
    jobs.score_stream(
        fixtures.decorate(documents).select("tweet_id", "lang", "text"),
        learn.SentimentModel.load(spark, stored),
        sink,
        fresh_path(spark, "offsets"),
        tokenizer=tk.whitespace_tokens,
    ).awaitTermination()
    return spark.read.parquet(sink).select(
        "tweet_id", rounded("margin"), rounded("probability"), big("prediction")
    )


QUERIES: dict[str, Query] = {
    "read_backup_json": read_backup_json,
    "read_polarity_csv": read_polarity_csv,
    "corpus_roundtrip": corpus_roundtrip,
    "vocab_roundtrip": vocab_roundtrip,
    "tfidf_roundtrip": tfidf_roundtrip,
    "collect_lang_filter": collect_lang_filter,
    "collect_emoticon_filter": collect_emoticon_filter,
    "collect_timestamp": collect_timestamp,
    "collect_year_window": collect_year_window,
    "collect_limit": collect_limit,
    "collect_tweets": collect_tweets,
    "collect_all_tweets": collect_all_tweets,
    "polarity_labels": polarity_labels,
    "elongation": elongation,
    "squeeze_whitespace": squeeze_whitespace,
    "split_edge_punct": split_edge_punct,
    "tokenize_twitter": tokenize_twitter,
    "tokenize_twitter_tokens": tokenize_twitter_tokens,
    "tokenize_raw": tokenize_raw,
    "split_contractions": split_contractions,
    "entity_counts": entity_counts,
    "entity_tokens": entity_tokens,
    "hashtag_mention_counts": hashtag_mention_counts,
    "stopword_filter": stopword_filter,
    "retweet_filter": retweet_filter,
    "tokenize_whitespace": tokenize_whitespace,
    "negation_scope": negation_scope,
    "negation_count": negation_count,
    "mention_normalize": mention_normalize,
    "url_normalize": url_normalize,
    "exclamation_count": _count_query("!", "exclam_count"),
    "question_count": _count_query("?", "question_count"),
    "hashtag_count": _count_query("#", "hashtag_count"),
    "token_count": token_count,
    "emoticon_label": emoticon_label,
    "distant_label_counts": distant_label_counts,
    "corpus_normalize": corpus_normalize,
    "process_tweets": process_tweets,
    "process_tweets_by_language": process_tweets_by_language,
    "process_tweets_twitter": process_tweets_twitter,
    "ngrams": ngrams,
    "document_frequency": document_frequency,
    "idf_fit": idf_fit,
    "idf_per_language": idf_per_language,
    "tfidf_fit_transform": tfidf_fit_transform,
    "tfidf_transform": tfidf_transform,
    "scale_features": scale_features,
    "feature_matrix": feature_matrix,
    "feature_matrix_all_languages": feature_matrix_all_languages,
    "feature_vectors_all_languages": feature_vectors_all_languages,
    "clear_unlabeled": clear_unlabeled,
    "split_positional": split_positional_query,
    "lr_fit": lr_fit,
    "lr_predict": lr_predict,
    "lr_gradient": lr_gradient,
    "lr_fit_counts": lr_fit_counts,
    "lr_predict_counts": lr_predict_counts,
    "experiment_counts": experiment_counts,
    "linear_score": linear_score,
    "score_all_languages": score_all_languages,
    "metric_accuracy": metric_accuracy,
    "metric_macro_f1": metric_macro_f1,
    "metric_auc_hard": metric_auc_hard,
    "metric_auc_score": metric_auc_score,
    "metric_report": metric_report,
    "experiment_labeled": experiment_labeled,
    "experiment_distant": experiment_distant,
    "stream_collect": stream_collect,
    "stream_score": stream_score,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tweets to TF-IDF with the twitter tokenizer, all languages in one job."""
    _, matrix = vz.fit_transform(process(_tweets(spark, sf_dir).drop("ts_ms")))
    return matrix.select("tweet_id", "lang", "term", rounded("tfidf"))
