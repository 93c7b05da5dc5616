"""Hand-derived results of the decorations and of single texts."""

import pytest
from pyspark.sql import functions as F

from moodfeed.functions import text as tx
from moodfeed.functions import tokens as tk
from moodfeed.operators.process import entities, process

# decoration, counts (rep, #, !, ?, negation, tokens), label, corpus
DECORATED = [
    (" :)", (0, 0, 0, 0, 0, 2), 1, "abc"),
    (" :(", (0, 0, 0, 0, 0, 2), -1, "abc"),
    (" not good :)", (0, 0, 0, 0, 1, 4), 1, "abc not___good"),
    (" soooo happy!!! :D", (2, 0, 1, 0, 0, 5), 1, "abc soo happy"),
    (" @user_1 see http://t.co/abc1 =)", (0, 0, 0, 0, 0, 5), 1, "abc ___mention___ see ___url___"),
    (" #fail :-(", (0, 1, 0, 0, 0, 3), 1, "abc #fail "),
    (" why?! ;(", (0, 0, 0, 1, 0, 3), None, "abc"),
    (" (:", (0, 0, 0, 0, 0, 2), 1, "abc"),
    (" not not good", (0, 0, 0, 0, 1, 4), None, "abc not___not good"),
    (" RT @bob: ok ^_^", (0, 0, 0, 0, 0, 6), 1, "abc ___mention___ ^_^"),
    (" www.foo.com =(", (1, 0, 0, 0, 0, 3), -1, "abc wwfoocom"),
    (" price 1000 at 12:30 ):", (1, 0, 0, 0, 0, 5), -1, "abc price 100 1230"),
    (" not", (0, 0, 0, 0, 1, 2), None, "abc not"),
    (" (#tag) very &amp; go", (0, 1, 0, 0, 0, 9), None, "abc #tag very amp"),
    (" :)) ^___^", (1, 0, 0, 0, 0, 3), 1, "abc  ^__^"),
    ("", (0, 0, 0, 0, 0, 1), None, "abc"),
]

TOKENS = [
    ("hello (#hashtag)", "hello ( #hashtag )"),
    ("hello (@person)", "hello ( @person )"),
    ("'foo' don't", "' foo ' don't"),
    ("(hello): x", "( hello ): x"),
    ("put it in a love song :-))", "put it in a love song :-))"),
    ("=))=))=)) oh well", "=)) =)) =)) oh well"),
    ("8) (8 d: ok", "8 ) ( 8 d : ok"),
    ("a &amp; b &lt;3", "a & amp ; b & lt ;3"),
    (
        "mail me a.b@c.com, u.n.k.l.e. 1,00 1.5%",
        "mail me a.b@c.com , u.n.k.l.e. 1 , 00 1.5%",
    ),
    ("not___time", "no t___t ime"),
    ("see http://t.co/abc1, ok", "see http://t.co/abc1 , ok"),
    ("visit foo.co.uk.", "visit foo.co.uk ."),
    ("1,234,567 at 12:30:15", "1,234,567 at 12:30:15"),
    ("mr. smith <3<3 $5.00", "mr. smith <3<3 $5.00"),
    ("a --> b <- c", "a --> b <- c"),
    ("(^_^) o_o", "(^_^) o_o"),
    ("  two spaces\t", "two spaces"),
    ("", ""),
]


def test_processed_decorations(spark):
    rows = [(i, "abc" + d) for i, (d, *_) in enumerate(DECORATED)]
    got = {
        r.tweet_id: r
        for r in process(spark.createDataFrame(rows, "tweet_id bigint, text string")).collect()
    }
    for i, (decoration, counts, label, corpus) in enumerate(DECORATED):
        r = got[i]
        found = (
            r.rep_count, r.hashtag_count, r.exclam_count, r.question_count, r.negation_count,
            r.token_count,
        )
        assert (found, r.label, r.corpus) == (counts, label, corpus), decoration


def test_tokens(spark):
    df = spark.createDataFrame([(t,) for t, _ in TOKENS], "text string")
    got = df.select("text", tk.twitter_tokens(F.col("text")).alias("tokens")).collect()
    for r, (text, expected) in zip(got, TOKENS):
        assert r.tokens == expected.split(), text
