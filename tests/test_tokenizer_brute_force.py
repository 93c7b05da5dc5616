"""The iterative patterns against plain ones, run by an engine that cannot overflow."""

import random
import time

import regex
from pyspark.sql import functions as F

from moodfeed import lexicon as lx
from moodfeed.functions import tokens as tk
from moodfeed.operators.process import entities
from moodfeed.sources import fixtures

SF = "/root/testdata/sf0.001"


def python_form(pattern: str) -> str:
    return regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), pattern)


# The token patterns as they are meant, without regard to speed.
def plain_patterns() -> dict[str, str]:
    word, edge = r"[\p{L}\p{N}_]", r"(?![\p{L}\p{N}_])"
    start = rf"(?<!{word})"
    country = "(?:" + "|".join(lx.COUNTRY_DOMAINS) + ")"
    domain = "(?:" + "|".join([*lx.GENERIC_DOMAINS, *lx.COUNTRY_DOMAINS]) + ")"
    border = rf"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"
    host = (
        rf"{border}(?:[A-Za-z\p{{Nd}}-])+(?:\.[A-Za-z0-9]+){{0,3}}\.{domain}(?:\.{country})?{edge}"
    )
    tail = rf"(?=(?:(?:{lx.PUNCTUATION}|{lx.HTML_ENTITY})+?)?(?:\.\.+|[<>]| |\Z))"
    nose = "(?:|-|[^a-zA-Z0-9 ])"
    mouth_end = rf"(?={edge}|RT|rt|Rt)"

    def face(name):
        center = r"(?:\.|[_-]+)"
        return (
            rf"(?:(?P<{name}>{lx.FACE_SIDE}){center}(?P={name})|--['\"]"
            rf"|{lx.ANGLE}[._-]+{lx.ANGLE}|\._+\.)"
        )

    east = (
        rf"{lx.EAST_LEFT}+(?:{face('a')}|[^{lx.EAST_SYMBOL_EXCLUDES}])+[{lx.EAST_RIGHT_CHARS}]+"
    )
    western = (
        rf"(?:>|&gt;)?{lx.EYES}(?:{nose}|[Oo])"
        rf"(?:{lx.TONGUE}{mouth_end}|(?:{lx.OTHER_MOUTH}){mouth_end}|{lx.SAD_MOUTH}|{lx.HAPPY_MOUTH})"
    )
    mirrored = (
        rf"(?:(?<= )|(?<=^))(?:{lx.SAD_MOUTH}|{lx.HAPPY_MOUTH}|{lx.OTHER_MOUTH})"
        rf"{nose}{lx.EYES}(?:<|&lt;)?"
    )
    before = rf"(?=\Z| |[“\"?!,:;]|{lx.HTML_ENTITY})"
    return {
        "heart": "(?:<+/?3+)+",
        "url": rf"(?:https?://|{start}www\.|{host})(?:[^. <>][^ <>]*?)?{tail}",
        "email": rf"{start}[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,4}}{edge}",
        "time": r"\p{Nd}+(?::\p{Nd}+){1,2}",
        "comma_number": r"(?:(?<!\p{Nd})\p{Nd}{1,3},)+?\p{Nd}{3}(?=[^,\p{Nd}]|\Z)",
        "number": rf"{lx.CURRENCY}?\p{{Nd}}+(?:\.\p{{Nd}}+)+%?",
        "emoticon": rf"{western}|{mirrored}|{east}|{face('b')}|[oO](?:\.|[_-]+)[oO]",
        "arrow": r"<*[\-―—=]*>+|<+[\-―—=]*>*|[\x{2190}-\x{21ff}]+",
        "entity": lx.HTML_ENTITY,
        "punctuation": lx.PUNCTUATION_RUN,
        "abbreviation": (
            rf"(?:[A-Za-z]\.){{2,}}{before}|[^A-Za-z](?:[A-Za-z]\.)+[A-Za-z]{before}"
            rf"|{start}(?:{lx.TITLES})\."
        ),
        "separator": lx.SEPARATOR,
        "decoration": lx.DECORATION,
        "apostrophe": rf"[^ .,?\"]+{lx.APOSTROPHE}[^ .,?\"]*",
        "hashtag": lx.HASHTAG,
        "mention": lx.MENTION,
    }


def brute_tokens(text: str, spans) -> list[str]:
    space = python_form(lx.SPACES)
    text = regex.sub(f"[{space}]+", " ", text).strip(" ")
    edge, content = f"([{lx.EDGE_SYMBOLS}]+)", f"([{lx.EDGE_CONTENT}])"
    limit = f"[{lx.EDGE_LIMITS} ]"
    text = regex.sub(rf"(^|{limit}){edge}{content}", r"\1\2 \3", text)
    text = regex.sub(rf"{content}{edge}({limit}|\Z)", r"\1 \2\3", text)
    tokens, end = [], 0
    for m in spans.finditer(text):
        tokens += text[end : m.start()].split(" ") + [m.group().strip(" ")]
        end = m.end()
    return [t for t in tokens + text[end:].split(" ") if t]


def compare(spark, texts):
    patterns = plain_patterns()
    spans = regex.compile(
        python_form("|".join(f"(?:{patterns[k]})" for k in lx.ENTITY_KINDS)), regex.V0
    )
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    rows = df.select(
        "text",
        tk.twitter_tokens(F.col("text")).alias("tokens"),
        F.transform(tk.tagged_tokens(F.col("text")), lambda t: t["token"]).alias("tagged"),
    ).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = brute_tokens(r.text, spans)
        assert r.tokens == expected, r.text
        assert r.tagged == expected, r.text


PIECES = (
    list("abcdDoOtTxXvVpsS0123ézß¬°♥•ಠ") + list(";:=-_.,!?'\"’()[]{}<>^*~/\\&@#%$|`+♪☆→—…ヽσっ丿（）")
    + [" ", " ", " ", "  ", "\t", "http://", "www.", "t.co", "foo.com", ".co.uk", "&lt;", "&gt;", "&amp;",
       "a.b.c", "mr.", "word", "not", "1,000", "12:30", "a@b.com", "rt", "^_^", "o_o", "don't", "t_t",
       "(^", "^)", ";_;", "--'", "<3", "-->", "$5.00"]
)


def test_random_texts(spark):
    rnd = random.Random(7)
    texts = [
        "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 24))) for _ in range(20000)
    ]
    symbols = ";^_.-='\"()<>~*oOt0♥•/&lgt"
    texts += [
        "(" + "".join(rnd.choice(symbols) for _ in range(rnd.randint(1, 16))) for _ in range(20000)
    ]
    compare(spark, texts)


def test_random_runs(spark):
    """Texts of the characters whose runs are tried once, with few spaces."""
    rnd = random.Random(11)
    kinds = [
        ["a", "b1", "é", "_", "-", "-", "--", ".", ".", "com", "co.uk", "t.co", "@", "+", "%", "x" * 70, " ", "'", "<"],
        list("=-=-~*<>|―—") + ["^", ";", "(", ")", "字", "o", ":", "--'", "d", " ", "&lt;", "$"],
        ["1", "12", "123", "1234", ",", ",", ",", ".", ":", "١", "$", "%", "a", "<3", " ", "'", "-", "(", "@"],
        ["http://", "www.", "a.com", "-", "..", "<", ",", "1", "1,", "@b", "#c", "'", "é", "_-", "-a", "=", ")", " "],
    ]
    texts = []
    for pieces in kinds:
        for _ in range(9000):
            texts.append("".join(rnd.choice(pieces) for _ in range(rnd.randint(2, 22))))
    compare(spark, texts)


def test_fixture_texts(spark):
    rows = fixtures.tweets(spark, SF).select(F.lower("text")).collect()
    compare(spark, [r[0] for r in rows])


N = 20000

LONG = {
    "(字": "(" + "字" * N, "(字)": "(" + "字" * N + ")", "^_^": "~" + "^_^" * N, "é": "é" * N, "1,": "1," * N,
    "1.1": "1.1" * N, "a.": "a." * N, "<3": "<3" * N, "!?": "http://a" + "!?" * N, "x'": "x'" * N, "o_": "o_" * N,
    "-": "-" * N, "=>": "=>" * N, "ab-": "ab-" * N, ":)": ":)" * N, "=-": "=-" * N, "a-b-": "a-b-" * N,
    "@a": "@a" * N, "a@": "a@" * N, ":-": ":-" * N, "12,": "12," * N, "*=": "*=" * N, "a+": "a+" * N,
    "':-": "':-" * N, "ab.": "ab." * N, "x-y.": "x-y." * N,
}


def forms():
    return [
        tk.twitter_tokens(F.col("text")),
        F.transform(tk.tagged_tokens(F.col("text")), lambda t: t["token"]),
    ]


def seconds(spark, text, tokens):
    df = spark.createDataFrame([(text,)], "text string").select("text", tokens.alias("tokens"))
    start = time.perf_counter()
    row = df.first()
    assert "".join(row.tokens) == text
    return time.perf_counter() - start


def test_long_unbroken_texts(spark):
    """None of them may overflow the stack, or take much longer than letters."""
    for tokens in forms():
        seconds(spark, "ab" * 100, tokens)
        letters = {}
        for name, text in LONG.items():
            # the same length of letters, with half a second for noise
            if len(text) not in letters:
                letters[len(text)] = seconds(spark, "a" * len(text), tokens)
            limit = 3 * letters[len(text)] + 0.5
            assert seconds(spark, text, tokens) < limit or seconds(spark, text, tokens) < limit, name


def test_long_runs_of_hosts(spark):
    """Every second word is a domain, so they take longer than letters, but eight times the text takes
    about eight times as long, not 64."""
    for tokens in forms():
        seconds(spark, "ab" * 100, tokens)
        short = min(seconds(spark, "abc.de." * N, tokens) for _ in range(2))
        assert seconds(spark, "abc.de." * 8 * N, tokens) < 16 * short


def test_tagged_kinds(spark):
    text = "see http://t.co/a #tag @bob :) <3 a@b.com 12:30 1,000 $5.00 --> &lt; !! mr. ~ ♪ don't word"
    found = entities(spark.createDataFrame([(1, text)], "tweet_id bigint, text string"))
    kinds = {r.token: r.kind for r in found.collect()}
    expected = {
        "see": None, "http://t.co/a": "url", "#tag": "hashtag", "@bob": "mention", ":)": "emoticon",
        "<3": "heart", "a@b.com": "email", "12:30": "time", "$5.00": "number", "-->": "arrow",
        "!!": "punctuation", "mr.": "abbreviation", "~": "separator", "♪": "decoration",
        "don't": "apostrophe", "word": None,
    }
    assert expected.items() <= kinds.items()
