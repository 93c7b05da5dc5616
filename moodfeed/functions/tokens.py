"""Tokenisers and token-list functions.

A tokeniser maps a text column to ``array<string>``; tokens hold no white space.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodfeed import lexicon as lx
from moodfeed.functions.text import bound as _bound
from moodfeed.functions.text import is_plain, split_edge_punctuation, squeeze_whitespace, unescape_html

Tokenizer = Callable[[Column], Column]

# Squeezed text holds no line feed, so it can mark borders without touching the text.
MARK = "\n"


def whitespace_tokens(text: Column) -> Column:
    def split(t: Column) -> Column:
        return F.when(is_plain(t), F.split(t, " ")).otherwise(F.split(t, f"[{lx.SPACES}]+"))

    return F.array_remove(_bound(text, split), "")


def twitter_tokens(text: Column) -> Column:
    """Links, emoticons, numbers and the like stay whole; the rest splits at spaces."""
    edged = split_edge_punctuation(squeeze_whitespace(text))
    # a border of a token and a space within one are cut alike; a single blank is split at without a pattern
    marked = _bound(edged, lambda e: _replace_spans(e, " $0 "))
    return F.array_remove(F.split(marked, " "), "")


def _replace_spans(text: Column, replacement: str, tagged: bool = False) -> Column:
    def replaced(*kinds: bool) -> Column:
        return F.regexp_replace(text, lx.protected_spans(tagged, *kinds), replacement)

    def by_address(apostrophes: bool) -> Column:
        address = F.contains(text, F.lit("@")) & text.rlike(lx.ADDRESS)
        return F.when(address, replaced(apostrophes, True)).otherwise(replaced(apostrophes, False))

    marks = [F.contains(text, F.lit(mark)) for mark in lx.APOSTROPHE.strip("[]")]
    return F.when(reduce(Column.__or__, marks), by_address(True)).otherwise(by_address(False))


def raw_twitter_tokens(text: Column) -> Column:
    """For HTML-escaped input."""
    return twitter_tokens(unescape_html(text))


def tagged_tokens(text: Column) -> Column:
    """``array<struct<kind, token>>``; kind is NULL for a plain word."""
    edged = split_edge_punctuation(squeeze_whitespace(text))
    # Only the group that matched is not empty; tabs before it tell the kind.
    groups = [lx.PLAIN, *lx.ENTITY_KINDS]
    fields = "\t".join(f"${{{lx.tag_name(kind)}}}" for kind in groups)
    marked = _bound(edged, lambda e: _replace_spans(e, f"{MARK}{fields}{MARK}", tagged=True))
    kinds = F.array(F.lit(None).cast("string"), *[F.lit(kind) for kind in lx.ENTITY_KINDS])

    def entity(piece: Column) -> Column:
        tabs = F.length(piece) - F.length(F.ltrim(piece, F.lit("\t")))
        return _tagged(F.get(kinds, tabs), F.trim(F.translate(piece, "\t", "")))

    def words(piece: Column) -> Column:
        split = F.split(F.translate(piece, "\t", ""), " ")
        return F.transform(split, lambda word: _tagged(F.lit(None).cast("string"), word))

    pieces = F.transform(
        F.split(marked, MARK),
        lambda p: F.when(F.startswith(p, F.lit("\t")), F.array(entity(p))).otherwise(words(p)),
    )
    return F.filter(F.flatten(pieces), lambda t: t["token"] != "")


def _tagged(kind: Column, token: Column) -> Column:
    return F.struct(kind.alias("kind"), token.alias("token"))


def split_contractions(tokens: Column) -> Column:
    """``don't`` becomes ``do`` and ``n't``."""
    pattern = rf"(?i)({lx.WORD}+)({lx.CONTRACTION_ENDINGS})\z"
    return F.flatten(
        F.transform(
            tokens,
            lambda t: F.when(
                t.rlike(pattern),
                F.array(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)),
            ).otherwise(F.array(t)),
        )
    )


def drop_noise(
    tokens: Column, stopwords: Sequence[str], retweet_case_insensitive: bool = False
) -> Column:
    """Without stopwords and tokens that begin with the retweet mark ``RT``."""

    def keep(token: Column) -> Column:
        start = F.upper(F.substring(token, 1, 2)) if retweet_case_insensitive else token
        kept = ~F.startswith(start, F.lit("RT"))
        return kept & ~token.isin(*stopwords) if stopwords else kept

    return F.filter(tokens, keep)


def drop_noise_by_language(
    tokens: Column, lang: Column, retweet_case_insensitive: bool = False
) -> Column:
    """``drop_noise`` with the stopwords of each row's language, those of English for others."""
    return by_language(
        lang, lambda code: drop_noise(tokens, lx.stopwords(code), retweet_case_insensitive)
    )


def by_language(lang: Column, rule: Callable[[str], Column]) -> Column:
    """The rule of each row's language; English for languages without one, and for NULL."""
    others = [code for code in lx.NEGATION_WORDS if code != lx.DEFAULT_LANGUAGE]
    choice = F.when(lang == others[0], rule(others[0]))
    for code in others[1:]:
        choice = choice.when(lang == code, rule(code))
    return choice.otherwise(rule(lx.DEFAULT_LANGUAGE))


def ngrams(tokens: Column, n: int = 2) -> Column:
    """All runs of 1 to n tokens, joined by a space."""
    return F.concat(tokens, *[_runs(tokens, width) for width in range(2, n + 1)])


def _runs(tokens: Column, width: int) -> Column:
    # each run of one token less and the token behind it
    runs = tokens
    for k in range(1, width):
        runs = F.zip_with(
            F.slice(runs, 1, F.size(tokens) - k), F.slice(tokens, k + 1, F.size(tokens) - k),
            lambda run, token: F.concat(run, F.lit(" "), token),
        )
    return F.when(F.size(tokens) >= width, runs).otherwise(F.array().cast("array<string>"))
