"""Word lists, symbol classes and token patterns."""

from __future__ import annotations

import os
import zipfile
from functools import lru_cache

import pyspark
from pyspark import SparkContext

# ---------------------------------------------------------------------------
# Results depend on each of them being exactly as written.

COLLECT_EMOTICONS = [
    ":-)", "(-:", "=)", "(=", "(:", ":)", ":-(", ")-:", "=(", ")=", ":(", "):", ":D", "^_^",
    "^__^", "^___^", ":d", "d:", ": )", "( :", ": (", ") :", "8)", "(8", "8(", ")8", "8 )",
    ") 8", "8 (", ";)", "(;", "; )", "( ;", ";-)", "(-;",
]

POSITIVE_EMOTICONS = [
    ":-)", "(-:", "=)", "(=", "(:", ":)", ":-(", ":D", "^_^", "^__^", "^___^", ":d", "d:",
    ": )", "( :", "8)", "(8", "8 )", ";)", "; )", "( ;", ";-)", "(-;", "(;",
]

STRIPPED_PUNCTUATION = ",;.:!?\"*'()-"

KEPT_STOPWORDS = ["not", "very", "extremely", "highly"]

MENTION_TOKEN = "___mention___"
URL_TOKEN = "___url___"
NEGATION_JOINER = "___"

NEGATION_WORDS = {"en": "not", "fr": "pas", "de": "nicht", "es": "no"}
DEFAULT_LANGUAGE = "en"  # of tweets in another language, or in none

ELONGATED = r"(?s)(.)\1{2,}"

# Unicode white space, U+180E included
SPACES = (
    r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\x{1680}"
    r"\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# texts whose only white space is single blanks, of letters below U+1680, where rarer white space begins
PLAIN_SPACED = r"\A ?(?:[!-~\xa1-\x{167f}]++ ?)*+\z"

EDGE_SYMBOLS = "'\"“”‘’«»{}\\(\\)\\[\\]\\*&"
EDGE_CONTENT = "a-zA-Z0-9"
EDGE_LIMITS = ":;.,"

CONTRACTION_ENDINGS = "n['’′]t|['’′]ve|['’′]ll|['’′]d|['’′]re|['’′]s|['’′]m"

GENERIC_DOMAINS = (
    "com org edu gov net mil aero asia biz cat coop info int jobs mobi museum name pro tel travel xxx"
).split()
COUNTRY_DOMAINS = (
    "ac ad ae af ag ai al am an ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br "
    "bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cs cu cv cx cy cz dd de dj dk dm do "
    "dz ec ee eg eh er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt "
    "gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr "
    "kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu "
    "mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw "
    "py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sy sz tc td tf "
    "tg th tj tk tl tm tn to tp tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt "
    "za zm zw"
).split()

PUNCTUATION = "['\"“”‘’.?!…,:;]"
PUNCTUATION_RUN = "['\"“”‘’]+|[.?!,…]+|[:;]+"
HTML_ENTITY = "&(?:amp|lt|gt|quot);"
CURRENCY = (
    r"[$\x{058f}\x{060b}\x{09f2}\x{09f3}\x{09fb}\x{0af1}\x{0bf9}\x{0e3f}"
    r"\x{17db}\x{a838}\x{fdfc}\x{fe69}\x{ff04}\x{ffe0}\x{ffe1}\x{ffe5}\x{ffe6}"
    r"\x{00a2}-\x{00a5}\x{20a0}-\x{20b9}]"
)
TITLES = "[Mm]r|[Mm]rs|[Mm]s|[Dd]r|[Ss]r|[Jj]r|[Rr]ep|[Ss]en|[Ss]t"
SEPARATOR = "--+|―|—|~|–|="
DECORATION = r"[♫♪]+|[★☆]+|[♥❤♡]+|[\x{2639}-\x{263b}]+|[\x{e001}-\x{ebbb}]+"
APOSTROPHE = "['’′]"
HASHTAG = "#[a-zA-Z0-9_]+"
MENTION = "[@＠][a-zA-Z0-9_]+"

EYES = "[:=;]"
TONGUE = "[pPd3]+"
OTHER_MOUTH = r"[oO]+|[/\\]+|[vV]+|[Ss]+|[|]+"
SAD_MOUTH = r"[(\[{]+"
HAPPY_MOUTH = r"[D)\]}]+"
FACE_SIDE = "[♥0oO°vV$tTxX;ಠ@ʘ•・◕\\^¬*]"
FACE_CENTER = r"(?:\.|[_-]+)"
ANGLE = "(?:<|&lt;|>|&gt;)"
EAST_LEFT = r"[＼\\ƪԄ(（<>;ヽ\-=~*]"
EAST_RIGHT_CHARS = r"\-=);'\x22<>ʃ）/／ノﾉ丿╯σっµ~*"
EAST_SYMBOL_EXCLUDES = "A-Za-z0-9 ()*:=\\-"

# End of the fixed values.
# ---------------------------------------------------------------------------

NEGATIVE_EMOTICONS = [e for e in COLLECT_EMOTICONS if e not in POSITIVE_EMOTICONS]

# Token kinds in the order in which they are tried; the first that matches wins.
ENTITY_KINDS = [
    "heart", "url", "email", "time", "comma_number", "number", "emoticon", "arrow", "entity",
    "punctuation", "abbreviation", "separator", "decoration", "apostrophe", "hashtag", "mention",
]

# words marked off together because no pattern begins in them
PLAIN = "plain"


def emoticons(strict: bool = False) -> tuple[list[str], list[str]]:
    """(positive, negative). ``:-(`` counts as positive unless ``strict``."""
    if not strict:
        return POSITIVE_EMOTICONS, NEGATIVE_EMOTICONS
    return [e for e in POSITIVE_EMOTICONS if e != ":-("], NEGATIVE_EMOTICONS + [":-("]


SPARK_STOPWORD_LISTS = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}


@lru_cache(maxsize=None)
def stopwords(lang: str = "en") -> tuple[str, ...]:
    """Spark's list for the language without the words that carry sentiment."""
    words = _spark_stopwords(SPARK_STOPWORD_LISTS[lang])
    kept = set(KEPT_STOPWORDS) if lang == "en" else {NEGATION_WORDS[lang]}
    return tuple(w for w in words if w not in kept)


def _spark_stopwords(name: str) -> list[str]:
    if SparkContext._active_spark_context is not None:
        from pyspark.ml.feature import StopWordsRemover

        return list(StopWordsRemover.loadDefaultStopWords(name))
    # Without a running JVM (building the check SQL) read the same resource from Spark's jar.
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    jars = os.path.join(home, "jars")
    jar = next(f for f in sorted(os.listdir(jars)) if f.startswith("spark-mllib_"))
    with zipfile.ZipFile(os.path.join(jars, jar)) as z:
        text = z.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt").decode("utf-8")
    return text.split("\n") if not text.endswith("\n") else text[:-1].split("\n")


# ---------------------------------------------------------------------------
# Token patterns (java.util.regex). They expect squeezed text, so the only white space is U+0020.
#
# A plain (A|B)+ makes java.util.regex recurse once per repetition and overflow its stack on long
# unbroken texts. Every such loop is therefore possessive, which runs iteratively. It is used only
# where giving back repetitions could never turn a failure into a match; the east-Asian emoticons,
# where it could, carry a look-ahead that decides each step instead.

WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
NOT_IN_WORD = rf"(?<!{WORD})"
WORD_ENDS = rf"(?!{WORD})"
# Letters that a look-behind passes to the beginning of a word; longer words are tried once more.
BEHIND = 64


def _face(name: str) -> str:
    return (
        rf"(?:(?<{name}>{FACE_SIDE}){FACE_CENTER}\k<{name}>|--['\"]"
        rf"|{ANGLE}[._-]+{ANGLE}|\._+\.)"
    )


def _url() -> str:
    country = "(?:" + "|".join(COUNTRY_DOMAINS) + ")"
    domain = "(?:" + "|".join(GENERIC_DOMAINS) + "|" + "|".join(COUNTRY_DOMAINS) + ")"
    scheme = rf"(?:https?://|{NOT_IN_WORD}www\.)"
    # A run of letters, digits and hyphens ends in one way wherever it is entered: it is tried where a
    # word begins it, not at the hyphens and words after that, unless the last match ended in between.
    letters = f"[A-Za-z{DIGIT}]"
    word_begins = rf"{NOT_IN_WORD}(?={letters})(?:\G|(?<!{WORD}-))"
    hyphen = (
        rf"(?<={WORD})(?=-)"
        rf"(?:(?<=\G{letters}{{0,{BEHIND}}})|(?<!{NOT_IN_WORD}{letters}{{1,{BEHIND}}}))"
    )
    host = (
        rf"(?:{word_begins}|{hyphen})[A-Za-z{DIGIT}-]++"
        rf"(?:\.[A-Za-z0-9]+){{0,3}}\.{domain}(?:\.{country})?{WORD_ENDS}"
    )
    end = r"(?:\.\.|[<>]| |\z)"
    body = r"(?:[^. <>][^ <>]*?)?"
    # the body stops where only punctuation separates it from the end
    return rf"(?:{scheme}|{host}){body}(?=(?:(?!{end})(?:{PUNCTUATION}|{HTML_ENTITY}))*+{end})"


# every mail address has this in it
ADDRESS = "[a-zA-Z0-9._%+-]@[a-zA-Z0-9.-]"


def _email() -> str:
    # as with hosts: not at a word that follows another one in the same run
    word = f"[a-zA-Z0-9_]{{0,{BEHIND}}}[.%+-]"
    first = rf"(?:\G|(?<=\G{word})|(?<!{NOT_IN_WORD}{word}))"
    return rf"{NOT_IN_WORD}{first}[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,4}}{WORD_ENDS}"


def _east_asian() -> str:
    """LEFT+ (face | symbol)+ RIGHT+, where a face is preferred to a symbol and longer to shorter.

    A step is taken only if a RIGHT character can still be reached after it. ``reach`` walks
    symbol by symbol and jumps only over the faces a symbol cannot enter; a face with a hyphen
    inside needs no jump, since the hyphen is itself a RIGHT character.
    """
    symbol = f"[^{EAST_SYMBOL_EXCLUDES}]"
    plain = f"[^{EAST_SYMBOL_EXCLUDES}{EAST_RIGHT_CHARS}]"
    right = f"[{EAST_RIGHT_CHARS}]"
    jump = rf"(?<eaj>[0oOvVtTxX]){FACE_CENTER}\k<eaj>|&[lg]t;[._-]+{ANGLE}"
    reach = rf"(?=(?:(?!{right})(?:{jump}|{symbol}))*+{right})"
    steps = rf"(?:(?:(?:(?!{_face('ear')}){plain})++|{_face('eas')}|{symbol}){reach})++"
    # if none begins at the first LEFT character of a run, none begins at the others; after four of
    # these the last match was a separator or an arrow in the run, at which this was tried before
    first = rf"(?:\G|(?<!{EAST_LEFT}))(?!(?<=[\-=*~]{{4}})[\-=*~])"
    return rf"{first}{EAST_LEFT}+(?=[-*0oOvVtTxX]|{symbol}){steps}{right}+"


def _emoticon() -> str:
    ends = rf"(?={WORD_ENDS}|RT|rt|Rt)"
    nose = "[^a-zA-Z0-9 ]"
    western = (
        rf"(?:>|&gt;)?{EYES}[{nose}Oo]??"
        rf"(?:{TONGUE}{ends}|(?:{OTHER_MOUTH}){ends}|{SAD_MOUTH}|{HAPPY_MOUTH})"
    )
    mirrored = (
        rf"(?:(?<= )|^)(?:{SAD_MOUTH}|{HAPPY_MOUTH}|{OTHER_MOUTH}){nose}??{EYES}(?:<|&lt;)?"
    )
    return "|".join([western, mirrored, _east_asian(), _face("fc"), rf"[oO]{FACE_CENTER}[oO]"])


def _abbreviation() -> str:
    before_other = rf"(?=\z| |[“\"?!,:;]|{HTML_ENTITY})"
    return (
        rf"(?:[A-Za-z]\.){{2,}}{before_other}"
        rf"|[^A-Za-z](?:[A-Za-z]\.)+[A-Za-z]{before_other}"
        rf"|{NOT_IN_WORD}(?:{TITLES})\."
    )


@lru_cache(maxsize=None)
def protected_spans(tagged: bool = False, apostrophes: bool = True, addresses: bool = True) -> str:
    """Spans that stay one token. ``tagged`` names a group after each kind. For texts without an
    apostrophe, or without what ``ADDRESS`` finds, the patterns that look for one after every match can be
    left out."""
    # \G, the end of the last match, goes with tests that skip places inside a run: a pattern that
    # failed where the run, or the search, began fails inside it too.
    chunk = "[^ .,?\\\"]"
    unquoted = "[^ .,?\\\"'’′]"
    apostrophe = (
        rf"(?:\G|(?<!{chunk}))(?={chunk}{unquoted}*+{APOSTROPHE}){chunk}+{APOSTROPHE}{chunk}*"
    )
    patterns = {
        "heart": "(?:<+/?3+)++",
        "url": _url(),
        "email": _email(),
        "time": rf"{DIGIT}++(?::{DIGIT}+){{1,2}}",
        "comma_number": (
            rf"(?<!{DIGIT})(?:\G(?<!(?<!{DIGIT}){DIGIT}{{1,3}},{DIGIT}{{1,3}},)"
            rf"|(?<!(?<!{DIGIT}){DIGIT}{{1,3}},))"
            rf"(?:{DIGIT}{{1,3}},)++{DIGIT}{{3}}(?=[^,{DIGIT}]|\z)"
        ),
        "number": rf"{CURRENCY}?{DIGIT}++(?:\.{DIGIT}+)++%?",
        "emoticon": _emoticon(),
        # after three dashes the last match was a separator in the run, at which this was tried before
        "arrow": (
            r"(?!(?<=[\-=]{3})[\-=])<*+[\-―—=]*+>++|<++[\-―—=]*+>*+|[\x{2190}-\x{21ff}]+"
        ),
        "entity": HTML_ENTITY,
        "punctuation": PUNCTUATION_RUN,
        "abbreviation": _abbreviation(),
        "separator": SEPARATOR,
        "decoration": DECORATION,
        "apostrophe": apostrophe,
        "hashtag": HASHTAG,
        "mention": MENTION,
    }
    # Inside a run of ASCII letters and digits only few patterns can begin; skip the rest at once.
    may_begin = (
        r"(?=\G|(?<![A-Za-z0-9])|[^A-Za-z0-9]|.[._-]|http|[0-9][A-Za-z]|(?<![0-9])[0-9])"
    )
    if not apostrophes:
        patterns["apostrophe"] = "(?!)"
    if not addresses:
        patterns["email"] = "(?!)"
    if tagged:
        spans = "|".join(f"(?<{tag_name(kind)}>{patterns[kind]})" for kind in ENTITY_KINDS)
        return f"(?<{tag_name(PLAIN)}>{_plain_words()})|{may_begin}(?:{spans})"
    spans = "|".join(f"(?:{patterns[kind]})" for kind in ENTITY_KINDS)
    return f"{_plain_words(marks=True)}|{may_begin}(?:{spans})"


def _plain_words(marks: bool = False) -> str:
    """Most of a text: words of Latin letters up to a space, with or without a mark, or the end,
    and, if wanted, these marks.

    No other pattern begins inside them, so marking them off as well changes no token and lets the
    search pass over them in one step. A space may begin an abbreviation and is left then; a full
    stop may belong to a title, but not after four letters.
    """
    letter = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
    space = r" (?![A-Za-z]\.)"
    return (
        rf"(?:\G|(?<![^ ]))(?:(?:{letter}++{space})++|{letter}{{4,}}+(?=[.,!?]?(?: |\z))"
        rf"|{letter}++(?=[,!?]?(?: |\z))"
        + (rf"|[.,!?]++(?:\z|{space}|(?= ))" if marks else "")
        + ")"
    )


def tag_name(kind: str) -> str:
    return "k" + kind.replace("_", "")
