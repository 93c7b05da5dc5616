"""Whole-text normalisation."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodfeed import lexicon as lx


def count_elongations(text: Column) -> Column:
    """Runs of three or more equal characters."""
    return F.regexp_count(text, F.lit(lx.ELONGATED))


def truncate_elongations(text: Column) -> Column:
    return F.regexp_replace(text, lx.ELONGATED, "$1$1")


def bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """The rule of a value that is computed once, however often the rule names it. Spark computes what is
    repeated below a function of arrays (a filter of the tokens, say) each time."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def is_plain(text: Column) -> Column:
    """Whether single blanks are the only white space, by one pass without matches at each of them. Other
    texts of distant scripts may be told so, too: they take the long way."""
    return text.rlike(lx.PLAIN_SPACED)


def squeeze_whitespace(text: Column) -> Column:
    def squeezed(t: Column) -> Column:
        return F.when(is_plain(t), t).otherwise(F.regexp_replace(t, f"[{lx.SPACES}]+", " "))

    return F.trim(bound(text, squeezed))


def split_edge_punctuation(text: Column) -> Column:
    """Set quotes, brackets, ``*`` and ``&`` at the edge of a word apart from it."""
    edge, content = f"[{lx.EDGE_SYMBOLS}]", f"[{lx.EDGE_CONTENT}]"
    limits = f"{lx.EDGE_LIMITS}{lx.SPACES}"
    opening = rf"(?={edge})(?<![^{limits}]){edge}++(?={content})"
    closing = rf"(?={edge})(?<={content}){edge}++(?=[{limits}]|\z)"
    # what both patterns need, in one pass
    beside = f"{edge}(?:(?={content})|(?<={content}{edge}))"

    def split(t: Column) -> Column:
        apart = F.regexp_replace(F.regexp_replace(t, opening, "$0 "), closing, " $0")
        return F.when(t.rlike(beside), apart).otherwise(t)

    return bound(text, split)


def unescape_html(text: Column) -> Column:
    """``&amp;`` first, as texts may be escaped twice, then each entity once."""
    once = F.replace(text, F.lit("&amp;"), F.lit("&"))
    entity = rf"&(?:#[xX]?[0-9a-fA-F]+|{lx.WORD}{{1,8}});"
    # cut before every entity and after every semicolon, translate the pieces, join them again
    pieces = F.split(once, f"(?={entity})|(?<=;)")
    whole = F.array_join(F.transform(pieces, lambda p: F.coalesce(_character(p), p)), "")
    return F.when(once.rlike(entity), whole).otherwise(once)


def _character(piece: Column) -> Column:
    """What an entity stands for; NULL for other text and unknown entities."""
    named = {f"&{n};": chr(c) for n, c in {"apos": ord("'"), **name2codepoint}.items()}
    table = F.from_json(F.lit(json.dumps(named)), "map<string,string>")
    decimal = F.regexp_extract(piece, "^&#0*([0-9]{1,7});$", 1).try_cast("bigint")
    hexadecimal = F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]{1,6});$", 1)
    code = F.coalesce(decimal, F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10).cast("bigint"))
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    # the code as the four bytes of UTF-32
    numeric = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
    return F.when(piece.rlike("^&.+;$"), F.coalesce(F.try_element_at(table, piece), numeric))
