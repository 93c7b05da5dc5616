"""Normalisation: tweets to tokens, features, label and corpus string. No shuffle anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodfeed import lexicon as lx
from moodfeed.functions import features as fx
from moodfeed.functions import text as tx
from moodfeed.functions import tokens as tk

COUNTS = [
    "rep_count", "hashtag_count", "exclam_count", "question_count", "negation_count", "token_count",
]


def tokenize(
    tweets: DataFrame,
    tokenizer: tk.Tokenizer = tk.twitter_tokens,
    stopwords: Sequence[str] | None = None,
    negation_word: str = "not",
    retweet_case_insensitive: bool = False,
    text_col: str = "text",
    lang_rules: bool = False,
) -> DataFrame:
    """Replace the text by ``rep_count``, ``negation_count`` and the marked ``tokens``.

    Each step is a projection of its own, so that later columns read the array instead of
    repeating the patterns. Generating the token list, as one row, keeps later filters (on the
    label, say) above it: pushed below, they would tokenise a second time.

    With ``lang_rules`` stopwords and negation word are those of the row's ``lang`` (English for other
    languages and for NULL), and the two arguments are not used.
    """
    words = lx.stopwords() if stopwords is None else stopwords
    lang = F.col("lang") if lang_rules else None
    others = [c for c in tweets.columns if c != text_col]
    lowered = tweets.select(*others, F.lower(text_col).alias("_text"))
    runs = lowered.select(*others, "_text", tx.count_elongations(F.col("_text")).alias("rep_count"))
    # most texts have none to cut
    cut = F.when(F.col("rep_count") == 0, F.col("_text")).otherwise(tx.truncate_elongations(F.col("_text")))
    counted = runs.select(*others, "rep_count", tokenizer(cut).alias("_all"))
    kept = counted.select(
        *others,
        "rep_count",
        (
            tk.drop_noise_by_language(F.col("_all"), lang, retweet_case_insensitive)
            if lang_rules
            else tk.drop_noise(F.col("_all"), words, retweet_case_insensitive)
        ).alias("_kept"),
    )
    if lang_rules:
        count, marked = (
            tk.by_language(lang, lambda code: rule(F.col("_kept"), lx.NEGATION_WORDS[code]))
            for rule in (fx.count_negations, fx.mark_negation)
        )
    else:
        count, marked = (
            rule(F.col("_kept"), negation_word) for rule in (fx.count_negations, fx.mark_negation)
        )
    return kept.select(
        *others,
        "rep_count",
        count.alias("negation_count"),
        F.explode(F.array(marked)).alias("tokens"),
    )


def process(tweets: DataFrame, strict_emoticons: bool = False, **options) -> DataFrame:
    """Corpus string, six counts and label of every tweet; see ``tokenize`` for the options.

    The label is +1, -1 or NULL where no emoticon decides.
    """
    tokens = F.col("tokens")
    text_col = options.get("text_col", "text")
    others = [c for c in tweets.columns if c != text_col]
    return tokenize(tweets, **options).select(
        *others,
        fx.corpus_string(fx.normalize_references(tokens)).alias("corpus"),
        "rep_count",
        fx.count_starting(tokens, "#").alias("hashtag_count"),
        fx.count_starting(tokens, "!").alias("exclam_count"),
        fx.count_starting(tokens, "?").alias("question_count"),
        "negation_count",
        F.size(tokens).alias("token_count"),
        fx.emoticon_label(tokens, strict_emoticons).alias("label"),
    )


def drop_unlabeled(rows: DataFrame) -> DataFrame:
    """Without the rows whose label could not be inferred."""
    return rows.filter(F.col("label").isNotNull())


def entities(tweets: DataFrame, text_col: str = "text") -> DataFrame:
    """Token table ``(…, pos, kind, token)``; kind is NULL for plain words."""
    others = [c for c in tweets.columns if c != text_col]
    lowered = tweets.select(
        *others, tx.truncate_elongations(F.lower(text_col)).alias("_text")
    )
    # outer, since the plain form would tokenise once more to filter empty lists beforehand
    tagged = F.posexplode_outer(tk.tagged_tokens(F.col("_text"))).alias("pos", "_tagged")
    return (
        lowered.select(*others, tagged)
        .filter(F.col("pos").isNotNull())
        .select(*others, "pos", "_tagged.kind", "_tagged.token")
    )
