"""Features, label and corpus string of a token list.

``mark_negation`` comes first: the others are defined on its result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodfeed import lexicon as lx
from moodfeed.functions.tokens import MARK


def mark_negation(tokens: Column, word: str = "not") -> Column:
    """The word becomes a blank and its successor is prefixed; a last one stays.

    A successor is used up, so only every second word of a run negates.
    """
    plain, word = word, re.escape(word)
    marked = F.regexp_replace(
        F.array_join(tokens, MARK),
        rf"(?<![^{MARK}]){word}{MARK}([^{MARK}]*)",
        f"{MARK}{word}{lx.NEGATION_JOINER}$1",
    )
    return F.when((F.size(tokens) > 0) & _may_hold(tokens, plain), F.split(marked, MARK)).otherwise(tokens)


def count_negations(tokens: Column, word: str = "not") -> Column:
    """Negated contexts of the list before marking, a last bare word included."""
    pattern = rf"(?<![^{MARK}]){re.escape(word)}(?:{MARK}[^{MARK}]*|\z)"
    counted = F.regexp_count(F.array_join(tokens, MARK), F.lit(pattern))
    return F.when(_may_hold(tokens, word), counted).when(tokens.isNotNull(), 0)


def _may_hold(tokens: Column, word: str) -> Column:
    """Whether the patterns need looking at: most lists lack the word."""
    return F.coalesce(F.array_contains(tokens, word), F.lit(True))


def normalize_mentions(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(_is_mention(t), lx.MENTION_TOKEN).otherwise(t))


def normalize_urls(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(_is_url(t), lx.URL_TOKEN).otherwise(t))


def normalize_references(tokens: Column) -> Column:
    """Mentions and links in one pass."""
    return F.transform(
        tokens,
        lambda t: F.when(_is_mention(t), lx.MENTION_TOKEN)
        .when(_is_url(t), lx.URL_TOKEN)
        .otherwise(t),
    )


def _is_mention(token: Column) -> Column:
    return F.startswith(token, F.lit("@")) | F.startswith(token, F.lit(".@"))


def _is_url(token: Column) -> Column:
    return F.startswith(token, F.lit("http")) | F.startswith(token, F.lit("www"))


def count_starting(tokens: Column, prefix: str) -> Column:
    return F.size(F.filter(tokens, lambda t: F.startswith(t, F.lit(prefix))))


def emoticon_label(tokens: Column, strict: bool = False) -> Column:
    """+1 or -1 by the first emoticon token, NULL without one."""
    positive, negative = lx.emoticons(strict)
    first = F.get(F.filter(tokens, lambda t: t.isin(*positive, *negative)), F.lit(0))
    return F.when(first.isin(*positive), 1).when(first.isNotNull(), -1)


def corpus_string(tokens: Column) -> Column:
    """Tokens of three or more characters, joined, then freed of punctuation."""
    kept = F.filter(tokens, lambda t: F.length(t) > 2)
    return F.translate(F.array_join(kept, " "), lx.STRIPPED_PUNCTUATION, "")
