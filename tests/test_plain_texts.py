"""What takes the short way in the tokenizers agrees with the plain patterns."""

import random

from pyspark.sql import functions as F

from moodfeed import lexicon as lx
from moodfeed.functions import features as fx
from moodfeed.functions import text as tx
from moodfeed.functions import tokens as tk

PARTS = [
    "a", "é", "ok", "not", "not", "pas", "nothing", " ", " ", "  ", "\n", "\t", "\x85", "\xa0", " ",
    " ", "“", "”", "(", ")", "'", "*", "&", "7", ".", ":", "#x", "ß", "λ", "日本", "😀", "\x7f", "@",
]


def texts(spark):
    deal = random.Random(5)
    rows = ["", " ", "  ", " a", "a ", None, "not", "not not", "(a", "a)"]
    rows += ["".join(deal.choices(PARTS, k=deal.randint(1, 14))) for _ in range(4000)]
    return spark.createDataFrame([(r,) for r in rows], "t string")


def test_white_space_and_edges(spark):
    t = F.col("t")
    edge, content = f"[{lx.EDGE_SYMBOLS}]", f"[{lx.EDGE_CONTENT}]"
    limits = f"{lx.EDGE_LIMITS}{lx.SPACES}"
    opened = F.regexp_replace(t, rf"(?={edge})(?<![^{limits}]){edge}++(?={content})", "$0 ")
    pairs = [
        (tx.squeeze_whitespace(t), F.trim(F.regexp_replace(t, f"[{lx.SPACES}]+", " "))),
        (tk.whitespace_tokens(t), F.array_remove(F.split(t, f"[{lx.SPACES}]+"), "")),
        (
            tx.split_edge_punctuation(t),
            F.regexp_replace(opened, rf"(?={edge})(?<={content}){edge}++(?=[{limits}]|\z)", " $0"),
        ),
    ]
    for got, wanted in pairs:
        assert texts(spark).filter(~got.eqNullSafe(wanted)).count() == 0


def test_negation(spark):
    rows = texts(spark).select(tk.whitespace_tokens(F.col("t")).alias("tokens"))
    for r in rows.select(
        "tokens", fx.mark_negation(F.col("tokens")).alias("marked"), fx.count_negations(F.col("tokens")).alias("n")
    ).collect():
        if r.tokens is None:
            assert r.marked is None and r.n is None
            continue
        wanted, n, i = [], 0, 0
        while i < len(r.tokens):
            if r.tokens[i] == "not":
                n += 1
                if i + 1 < len(r.tokens):
                    wanted += ["", "not___" + r.tokens[i + 1]]
                    i += 2
                    continue
            wanted.append(r.tokens[i])
            i += 1
        assert (r.marked, r.n) == (wanted, n)


def test_texts_without_odd_white_space_have_no_matches_at_their_blanks(spark):
    rows = [("a b, c: été 1!", True), (" a b", True), ("a b ", True), ("", True)]
    rows += [("a  b", False), ("a\tb", False), ("a\xa0b", False), ("a b", False), ("a b", False)]
    # long texts do not overflow the stack
    rows += [("ab " * 100_000, True), ("a" * 300_000 + " " * 3, False)]
    df = spark.createDataFrame(rows, "t string, plain boolean")
    assert df.filter(tx.is_plain(F.col("t")) != F.col("plain")).count() == 0


def test_patterns_are_left_out_where_the_word_is_missing(spark):
    # the optimizer keeps one branch of a constant, so a plan shows what is guarded
    tokens = F.array(F.lit("a"), F.lit("b"))
    plan = spark.range(1).select(fx.mark_negation(tokens).alias("m"), fx.count_negations(tokens).alias("n"))
    assert "regexp" not in plan._jdf.queryExecution().optimizedPlan().toString()
