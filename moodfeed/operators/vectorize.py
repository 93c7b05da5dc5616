"""Binary TF-IDF of n-grams, one vocabulary per language, all languages in one job.

Matrices are long tables, a row per non-zero entry, or sparse vectors, a row per tweet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodfeed.functions import tokens as tk
from moodfeed.operators.joins import null_safe_join
from moodfeed.operators.process import COUNTS, process
from moodfeed.operators.ranking import with_position
from moodfeed.staging import fresh_path, no_shuffle_kept, stage

# Terms with more than this share of all postings are joined by broadcast: there are at most
# HOT_SHARE of them, and every other term is at most 1 / HOT_SHARE of the rows.
HOT_SHARE = 1 << 18
# The same where a corpus is counted beside its own entries.
OWN_SHARE = 1 << 18
# Tweets, about, whose terms tell which ones are likely to be that frequent before all are counted. Fewer
# unseen tweets than that are looked up in the vocabulary without moving it.
HOT_TWEETS = 20_000
# Entries of a task that puts tweets together again, about.
TASK_ENTRIES = 1_000_000


def tweet_terms(
    corpus: DataFrame, tokenizer: tk.Tokenizer = tk.twitter_tokens, n: int = 2
) -> DataFrame:
    """Distinct n-grams of each corpus string, as the array ``terms``."""
    return _distinct_ngrams(_corpus_tokens(corpus, tokenizer), n)


def _corpus_tokens(corpus: DataFrame, tokenizer: tk.Tokenizer) -> DataFrame:
    others = [c for c in corpus.columns if c != "corpus"]
    return corpus.select(*others, tokenizer(F.lower("corpus")).alias("_tokens"))


def _distinct_ngrams(tokens: DataFrame, n: int) -> DataFrame:
    others = [c for c in tokens.columns if c != "_tokens"]
    return tokens.select(
        *others, F.array_distinct(tk.ngrams(F.col("_tokens"), n)).alias("terms")
    )


def explode_terms(terms: DataFrame) -> DataFrame:
    # A plain explode would add a filter on the list's size, which Spark pushes down together with
    # the whole tokenising expression; the outer form does not.
    rows = terms.select("tweet_id", "lang", F.explode_outer("terms").alias("term"))
    return rows.filter(F.col("term").isNotNull())


def document_frequency(terms: DataFrame) -> DataFrame:
    """``lang, term, df``. Partial sums per task come before the shuffle."""
    return explode_terms(terms).groupBy("lang", "term").agg(F.count("*").alias("df"))


def fit_idf(terms: DataFrame, min_df: int = 1) -> DataFrame:
    """``lang, term, df, n_docs, idf`` with ``idf = ln((1 + n_docs) / (1 + df)) + 1``.

    Tweets without any term count as documents too.
    """
    return _with_idf(document_frequency(terms), _language_sizes(terms), min_df)


def _language_sizes(terms: DataFrame) -> DataFrame:
    # one row per language: staged, so that its size decides how it is joined
    return stage(terms.groupBy("lang").agg(F.count("*").alias("n_docs")), "sizes")


def _with_idf(df: DataFrame, sizes: DataFrame, min_df: int) -> DataFrame:
    others = [c for c in df.columns if c not in ("lang", "term", "df")]
    if min_df > 1:
        df = df.filter(F.col("df") >= min_df)
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    return null_safe_join(df, sizes, ["lang"]).select(
        *others, "lang", "term", "df", "n_docs", idf.alias("idf")
    )


def _likely_frequent(terms: DataFrame, tweets: int, share: int) -> tuple[DataFrame, int]:
    """(staged ``term, lang`` that are likely to have more than 1 / ``share`` of the rows, ``share`` of them at
    most; about the number of rows): as far as the tweets of some hashes of the id tell."""
    every = max(1, tweets // HOT_TWEETS)
    few = F.pmod(F.xxhash64("tweet_id", "lang"), F.lit(every)) == 0
    seen = stage(document_frequency(terms.filter(few)), "seen-terms")
    total = seen.agg(F.sum("df")).first()[0] or 0
    often = seen.filter(F.col("df") > total // share).select("term", "lang")
    return stage(often, "frequent-terms"), total * every


def own_frequencies(tokens: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """``tweet_id, lang, term, df``: each term of each tweet with its document frequency in these very tweets,
    counted where the term's rows meet; no vocabulary is joined to them.

    ``tokens`` are those of ``_stage_tokens``, ``sizes`` tell the number of tweets. Terms with a large share of
    the rows do not meet: some tweets tell which ones to look out for, these are counted in all tweets
    beforehand, with partial sums, and looked up at the end. It is only the way that is chosen so: every
    other term is counted in all tweets as well. Of those, only the place in the tweet comes back, with the
    frequency, unless that is 1; the tweet's tokens are moved once, and its terms are made from them again.
    """
    keys = ["term", "lang"]
    tweet = _tweet_keys(tokens)
    terms = _distinct_ngrams(tokens, n)
    tweets = sizes.agg(F.sum("n_docs")).first()[0] or 0
    often, entries = _likely_frequent(terms, tweets, OWN_SHARE)
    placed = terms.select(
        *tweet, "lang", F.posexplode_outer("terms").alias("_at", "term")
    ).filter(F.col("term").isNotNull())
    hot = None
    if not often.isEmpty():
        counted = null_safe_join(explode_terms(terms), F.broadcast(often), keys, never_null=("term",))
        hot = stage(counted.groupBy(*keys).agg(F.count("*").alias("_hot")), "hot-terms")
        placed = null_safe_join(placed, F.broadcast(hot.select(*keys)), keys, "left_anti", never_null=("term",))
    # a number that tells most terms apart is sorted by first; it is made after the shuffle
    met = placed.repartition(*keys).select(*tweet, "_at", _rows_of(F.xxhash64(*keys), *keys).alias("_df"))
    found = met.filter(F.col("_df") > 1).select(
        *tweet, F.shiftleft(F.col("_at").cast("bigint"), DF_BITS).bitwiseOR(F.col("_df")).alias("_found")
    )
    # the number of tasks is given: rows get many more than what is shuffled tells
    slots = tokens.sparkSession.sparkContext.defaultParallelism
    tasks = max(slots, entries // TASK_ENTRIES + 1)
    lists = found.repartition(tasks, *tweet).groupBy(*tweet).agg(F.sort_array(F.collect_list("_found")).alias("_found"))
    texts = tokens.select(*dict.fromkeys(["tweet_id", *tweet, "lang", "_tokens"])).repartition(tasks, *tweet)
    whole = null_safe_join(texts, lists, tweet, "left", never_null=tuple(tweet) if len(tweet) == 1 else ("_row",))
    pairs = _distinct_ngrams(whole, n).select(
        "tweet_id", "lang", F.inline_outer(F.arrays_zip(F.col("terms").alias("term"), _by_place("_found").alias("df")))
    )
    rows = pairs.toDF("tweet_id", "lang", "term", "df").filter(F.col("term").isNotNull())
    df = F.coalesce("df", F.lit(1))
    if hot is not None:
        rows = null_safe_join(rows, F.broadcast(hot), keys, "left", never_null=("term",))
        df = F.coalesce("_hot", df)
    return rows.select("tweet_id", "lang", "term", df.alias("df"))


def _tweet_keys(tokens: DataFrame) -> list[str]:
    """What tells the rows of ``_stage_tokens`` apart: the id, and the number as well if an id repeats or is NULL."""
    ids = tokens.groupBy("tweet_id").agg(F.count("*").alias("n"))
    with no_shuffle_kept(tokens.sparkSession):
        unique = ids.filter((F.col("n") > 1) | F.col("tweet_id").isNull()).isEmpty()
    return ["tweet_id"] if unique else ["_row", "tweet_id"]


# A place in a tweet and a frequency are one number, the frequency in its lower bits.
DF_BITS = 36


def _by_place(found: str) -> Column:
    """A sorted list of such numbers as the list of frequencies by place, with 1 in the gaps."""
    place = lambda e: F.shiftright(e, DF_BITS).cast("int")
    before = lambda i: F.coalesce(place(F.get(F.col(found), i - 1)), F.lit(-1))
    by_place = F.flatten(
        F.transform(
            found,
            lambda e, i: F.concat(
                F.array_repeat(F.lit(1).cast("bigint"), place(e) - before(i) - 1),
                F.array(e.bitwiseAND(F.lit((1 << DF_BITS) - 1))),
            ),
        )
    )
    return F.coalesce(by_place, F.array().cast("array<bigint>"))


def _rows_of(first: Column, *keys: str) -> Column:
    """How many rows have the same keys; a number that tells most of them apart is sorted by first."""
    return F.count("*").over(Window.partitionBy(first, *keys))


def with_term_ids(idf: DataFrame) -> DataFrame:
    """Add ``term_id``: the alphabetical place of the term in its language, from 0."""
    numbered = with_position(idf, ["lang", "term"], "_place")
    starts = stage(numbered.groupBy("lang").agg(F.min("_place").alias("_first")), "starts")
    return null_safe_join(numbered, starts, ["lang"]).select(
        "lang", "term", (F.col("_place") - F.col("_first")).alias("term_id"), "df", "n_docs", "idf"
    )


def fit_vocabulary(terms: DataFrame, min_df: int = 1) -> DataFrame:
    """``lang, term, term_id, df, n_docs, idf``."""
    return with_term_ids(fit_idf(terms, min_df))


# Of a stored vocabulary: terms of a folder, and folders, at most.
PREFIX_TERMS = 10_000
MAX_PREFIXES = 4096


def prefix_of(term: str, prefixes: int) -> Column:
    """The folder of a stored vocabulary that a term is in."""
    return F.pmod(F.xxhash64(term), F.lit(prefixes)).cast("int")


def narrowed(vocabulary: DataFrame, terms: DataFrame, prefixes: int) -> DataFrame:
    """The folders of a vocabulary with the column ``prefix`` that some of the terms are in; the others are
    not opened. The numbers of the folders, ``prefixes`` at most, pass through the driver."""
    wanted = [r[0] for r in terms.select(prefix_of("term", prefixes)).distinct().collect()]
    return vocabulary.filter(F.col("prefix").isin(wanted)).drop("prefix")


def join_vocabulary(
    terms: DataFrame, vocabulary: DataFrame, unseen: bool = False, prefixes: int = 0
) -> DataFrame:
    """``tweet_id, lang, term`` with the vocabulary's columns; terms it lacks go.

    Pass tables that are staged or stored: both are read more than once. ``unseen`` tells that the
    vocabulary was fitted on other tweets, so that its ``df`` says nothing about which terms are
    frequent here. Up to ``HOT_TWEETS`` tweets have their terms counted then, and only the vocabulary's rows of terms
    that occur here are looked at: a few tweets are broadcast to the vocabulary, which is not moved. Of a vocabulary in
    ``prefixes`` folders only those are read that hold terms which occur. Of more tweets some tell which terms are
    likely to be frequent, and the others meet the whole vocabulary.
    """
    # the term first: it tells rows apart, and sorts by its first bytes
    keys = ["term", "lang"]
    names = [c for c in vocabulary.columns if c not in (*keys, "prefix")]

    def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        return null_safe_join(left, right, keys, how, never_null=("term",))

    tweets = terms.count() if unseen else 0
    if unseen and tweets > HOT_TWEETS:
        lookup = vocabulary.select(*keys, *names)
        often, _ = _likely_frequent(terms, tweets, HOT_SHARE)
        hot = join(often, join(lookup, F.broadcast(often), "left_semi"), "left")
        others = lookup
    else:
        if unseen:
            counts = stage(document_frequency(terms).withColumnRenamed("df", "_rows"), "counts")
            if prefixes:
                vocabulary = narrowed(vocabulary, counts, prefixes)
            lookup = join(vocabulary, counts)
        else:
            lookup = vocabulary.withColumn("_rows", F.col("df"))
            counts = lookup.select(*keys, "_rows")
        postings = counts.agg(F.sum("_rows")).first()[0] or 0
        is_hot = F.col("_rows") > postings // HOT_SHARE
        # at most HOT_SHARE rows; also those that the vocabulary lacks: they must not meet in one task either
        hot = join(counts.filter(is_hot).select(*keys), lookup.filter(is_hot).select(*keys, *names), "left")
        others = lookup.filter(~is_hot)
    hot = stage(hot.select(*keys, *names, F.lit(True).alias("_hot")), "hot-terms")
    marked = join(explode_terms(terms), F.broadcast(hot), "left")
    known = F.col(names[0]).isNotNull()
    often = marked.filter(F.col("_hot") & known).select("tweet_id", *keys, *names)
    rest = marked.filter(F.col("_hot").isNull()).select("tweet_id", *keys)
    both = often.unionByName(join(rest, others).select("tweet_id", *keys, *names))
    return both.select("tweet_id", "lang", "term", *names)


def tfidf(terms: DataFrame, vocabulary: DataFrame, unseen: bool = False) -> DataFrame:
    """Rows of unit length: ``tweet_id, lang, term, [term_id,] tfidf``."""
    ids = [c for c in ("term_id",) if c in vocabulary.columns]
    wanted = vocabulary.select("lang", "term", *ids, "df", "idf")
    return _unit_rows(join_vocabulary(terms, wanted, unseen), ids)


def _unit_rows(entries: DataFrame, ids: list[str]) -> DataFrame:
    tweet = Window.partitionBy("tweet_id")
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(tweet))
    return entries.select("tweet_id", "lang", "term", *ids, (F.col("idf") / norm).alias("tfidf"))


def stage_terms(
    corpus: DataFrame, tokenizer: tk.Tokenizer = tk.twitter_tokens, n: int = 2
) -> DataFrame:
    """The n-grams of each tweet for several passes over them. The tokens are kept, a third of their size or less."""
    return _distinct_ngrams(_stage_tokens(corpus, tokenizer), n).drop("_row")


def _stage_tokens(corpus: DataFrame, tokenizer: tk.Tokenizer) -> DataFrame:
    """``tweet_id, lang, _tokens, _row``; the number tells rows apart, where an id may repeat."""
    tokens = _corpus_tokens(corpus.select("tweet_id", "lang", "corpus"), tokenizer)
    return stage(tokens.withColumn("_row", F.monotonically_increasing_id()), "tokens")


def fit_transform(
    corpus: DataFrame, tokenizer: tk.Tokenizer = tk.twitter_tokens, n: int = 2, min_df: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(vocabulary without ids, tfidf) of one corpus. Neither is staged; a term's frequency is counted beside
    its entries, so that the matrix does not wait for the vocabulary."""
    tokens = _stage_tokens(corpus, tokenizer)
    terms = _distinct_ngrams(tokens, n)
    sizes = _language_sizes(terms)
    vocabulary = _with_idf(document_frequency(terms), sizes, min_df)
    return vocabulary, _unit_rows(_with_idf(own_frequencies(tokens, sizes, n), sizes, min_df), [])


def feature_moments(features: DataFrame) -> DataFrame:
    """Mean and population deviation of the six counts, a row per language."""
    return features.groupBy("lang").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in COUNTS],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in COUNTS],
    )


def scale_features(features: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """``tweet_id, lang`` and the six counts as (x - mean) / deviation; constant ones become 0.

    The moments are those of ``features`` itself unless stored ones are given.
    """
    return with_scaled(features.select("tweet_id", "lang", *COUNTS), moments)


def with_scaled(features: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """All columns, the six counts scaled."""
    if moments is None:
        moments = stage(feature_moments(features), "moments")

    def scaled(c: str):
        deviation = F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std"))
        return ((F.col(c) - F.col(f"{c}_mean")) / deviation).alias(c)

    return null_safe_join(features, moments, ["lang"]).select(
        *[scaled(c) if c in COUNTS else c for c in features.columns]
    )


def unpivot_features(scaled: DataFrame) -> DataFrame:
    """``tweet_id, lang, feature, value``."""
    return scaled.unpivot(["tweet_id", "lang"], COUNTS, "feature", "value")


def feature_matrix(
    tweets: DataFrame,
    use_features: bool = False,
    vocabulary: DataFrame | None = None,
    tokenizer: tk.Tokenizer = tk.twitter_tokens,
    n: int = 2,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(matrix, labels): ``tweet_id, lang, feature, value`` and ``tweet_id, lang, label``.

    Fits a vocabulary unless a stored one is given.
    """
    processed = stage(process(tweets, tokenizer=tokenizer, **options), "processed")
    if vocabulary is None:
        _, entries = fit_transform(processed, tokenizer, n)
    else:
        entries = tfidf(stage_terms(processed, tokenizer, n), vocabulary, unseen=True)
    parts = [
        entries.select("tweet_id", "lang", F.col("term").alias("feature"), F.col("tfidf").alias("value"))
    ]
    if use_features:
        parts.append(unpivot_features(scale_features(processed)))
    return reduce(DataFrame.unionByName, parts), processed.select("tweet_id", "lang", "label")


# A sparse vector as it is stored: the kind 0, the size, and the entries in the order of their index.
_SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
MAX_SIZE = (1 << 31) - 1


def vocabulary_sizes(vocabulary: DataFrame) -> DataFrame:
    """``lang, n_terms`` of a vocabulary with term ids; staged, so that its size decides on the join."""
    sizes = vocabulary.groupBy("lang").agg((F.max("term_id") + 1).alias("n_terms"))
    return stage(sizes, "vocabulary-sizes")


def stage_vectors(
    rows: DataFrame, entries: DataFrame, sizes: DataFrame, columns: list[str], by_language: bool = False
) -> DataFrame:
    """``rows`` without ``columns``, and ``features``: a sparse vector of the tweet's terms followed by these
    columns, as wide as the vocabulary of its language and they are.

    ``rows`` have ``tweet_id, lang``; ``entries`` ``tweet_id, term_id, tfidf``. Tweets without a term, or
    whose language has no vocabulary, have the columns only. Spark's vector type has no constructor of
    sparse vectors in SQL: they are written as the structure that it is stored as, and read as vectors.
    ``by_language`` gives each language a folder (for tables without NULL languages).
    """
    spark = rows.sparkSession
    widest = sizes.agg(F.max("n_terms")).first()[0] or 0
    if widest + len(columns) > MAX_SIZE:
        raise ValueError(f"{widest} terms in a language: a vector has {MAX_SIZE} entries at most")
    # a tweet's own terms only
    own = entries.groupBy("tweet_id").agg(
        F.sort_array(F.collect_list(F.struct("term_id", "tfidf"))).alias("_own")
    )
    joined = null_safe_join(rows, sizes, ["lang"], "left").join(own, "tweet_id", "left")
    n, terms = F.coalesce("n_terms", F.lit(0)).cast("int"), F.coalesce("_own", F.array().cast(own.schema["_own"].dataType))
    indices = F.concat(
        F.transform(terms, lambda e: e["term_id"].cast("int")), F.array(*[n + k for k in range(len(columns))]).cast("array<int>")
    )
    values = F.concat(
        F.transform(terms, lambda e: e["tfidf"]), F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")
    )
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), (n + len(columns)).alias("size"),
        indices.alias("indices"), values.alias("values"),
    ).cast(_SPARSE)
    kept = [c for c in rows.columns if c not in columns]
    path = fresh_path(spark, "vectors")
    table = joined.select(*kept, vector.alias("features"))
    writer = table.write.option("compression", "zstd")
    with no_shuffle_kept(spark):
        (writer.partitionBy("lang") if by_language else writer).parquet(path)
    schema = T.StructType(
        [T.StructField("features", VectorUDT()) if f.name == "features" else f for f in table.schema]
    )
    return spark.read.schema(schema).parquet(path).select(*kept, "features")


def vector_entries(vectors: DataFrame) -> DataFrame:
    """``features`` turned into a row for each of its stored entries: ``index, value``."""
    others = [c for c in vectors.columns if c != "features"]
    stored = F.unwrap_udt("features")
    pairs: Column = F.arrays_zip(stored["indices"].alias("index"), stored["values"].alias("value"))
    return vectors.select(*others, F.inline(pairs)).toDF(*others, "index", "value")


def with_terms(entries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows with ``lang, term_id`` and the ``term`` that has this number; rows of none go. The vocabulary is staged;
    terms that are more than 1 / ``HOT_SHARE`` of its postings are broadcast, so that their rows stay where they are."""
    # the number first: it tells rows apart, where the few languages do not
    keys = ["term_id", "lang"]
    postings = vocabulary.agg(F.sum("df")).first()[0] or 0
    is_hot = F.col("df") > postings // HOT_SHARE
    hot = F.broadcast(vocabulary.filter(is_hot).select(*keys, "term"))
    marked = null_safe_join(entries, hot, keys, "left", never_null=("term_id",))
    rest = marked.filter(F.col("term").isNull()).drop("term")
    others = vocabulary.filter(~is_hot).select(*keys, "term")
    return marked.filter(F.col("term").isNotNull()).unionByName(
        null_safe_join(rest, others, keys, never_null=("term_id",))
    )


def feature_vectors(
    tweets: DataFrame,
    use_features: bool = False,
    vocabulary: DataFrame | None = None,
    tokenizer: tk.Tokenizer = tk.twitter_tokens,
    n: int = 2,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(vectors, vocabulary): ``tweet_id, lang, label, features`` of every tweet, as ``feature_matrix``, and
    the vocabulary that numbers the terms. The counts follow the terms of the language.

    Fits a vocabulary unless a stored one with term ids is given.
    """
    processed = stage(process(tweets, tokenizer=tokenizer, **options), "processed")
    terms = stage_terms(processed, tokenizer, n)
    fitted = vocabulary if vocabulary is not None else stage(fit_vocabulary(terms), "vocabulary")
    entries = tfidf(terms, fitted, unseen=vocabulary is not None)
    columns = COUNTS if use_features else []
    rows = with_scaled(processed) if use_features else processed
    return (
        stage_vectors(
            rows.select("tweet_id", "lang", "label", *columns), entries, vocabulary_sizes(fitted), columns
        ),
        fitted,
    )


def clear_unlabeled(matrix: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the tweets whose label is unknown."""
    known = labels.filter(F.col("label").isNotNull())
    return matrix.join(known.select("tweet_id"), "tweet_id", "left_semi"), known
