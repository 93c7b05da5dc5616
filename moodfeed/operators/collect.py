"""Collector: emoticon-bearing tweets of one language and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodfeed import lexicon as lx
from moodfeed.functions.tokens import whitespace_tokens
from moodfeed.operators.ranking import INTEGRAL, smallest, with_position


def in_language(rows: DataFrame, lang: str | int) -> DataFrame:
    """Rows without a language fail. Codes may be numbers."""
    return rows.filter(F.col("lang") == F.lit(str(lang)))


def with_emoticon(rows: DataFrame, emoticons: Sequence[str] | None = None) -> DataFrame:
    """A white-space token is an emoticon, case included."""
    wanted = F.array(*[F.lit(e) for e in emoticons or lx.COLLECT_EMOTICONS])
    return rows.filter(F.arrays_overlap(whitespace_tokens(F.col("text")), wanted))


def posted_at(ts_ms: Column) -> Column:
    """Time of an epoch-milliseconds string, its last three digits dropped."""
    seconds = F.substring(ts_ms, F.lit(1), F.length(ts_ms) - 3).try_cast("bigint")
    return F.timestamp_seconds(seconds)


def within_years(rows: DataFrame, as_of_year: int) -> DataFrame:
    """At most one year from the given one. Rows without a time fail."""
    return rows.filter(F.abs(F.year("posted_at") - F.lit(as_of_year)) <= 1)


def first_rows(rows: DataFrame, n: int = -1) -> DataFrame:
    """The first n by ``tweet_id``, and by the other columns where ids tie; -1 keeps all.

    Ids that are whole numbers are selected by histograms, others by a sort of all rows; in neither way
    does a single task have to hold n of them.
    """
    if n == -1:
        return rows
    if rows.schema["tweet_id"].dataType.simpleString() in INTEGRAL:
        return smallest(rows, n, "tweet_id")
    others = [c for c in rows.columns if c != "tweet_id"]
    numbered = with_position(rows, ["tweet_id", *others], "_position")
    return numbered.filter(F.col("_position") < n).drop("_position")


def select_tweets(rows: DataFrame, lang: str | int, as_of_year: int) -> DataFrame:
    """The row-wise part, fit for batch and stream; the cheapest test comes first."""
    timed = in_language(rows, lang).withColumn("posted_at", posted_at(F.col("ts_ms").cast("string")))
    return with_emoticon(within_years(timed, as_of_year))


def collect_tweets(
    rows: DataFrame, lang: str | int, as_of_year: int, limit: int = -1
) -> DataFrame:
    """``tweet_id, lang, text`` of the wanted tweets."""
    return first_rows(select_tweets(rows, lang, as_of_year), limit).select(
        "tweet_id", "lang", "text"
    )


def polarity_labels(rows: DataFrame) -> DataFrame:
    """Target 4 as +1 and 0 as -1; neutral rows go."""
    label = F.when(F.col("target") == 4, 1).when(F.col("target") == 0, -1)
    return rows.filter(F.col("target").isin(0, 4)).select("tweet_id", label.alias("label"), "text")
