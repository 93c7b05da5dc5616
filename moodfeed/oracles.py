"""DuckDB SQL that computes the registered queries independently.

DuckDB's patterns have neither back references nor look-around, so elongations are found as runs
of characters, negation as runs of tokens, labels and corpus strings by ordered aggregation.
"""

from __future__ import annotations

from moodfeed import lexicon as lx
from moodfeed.operators.process import COUNTS
from moodfeed.queries import COLLECT_LANG, COLLECT_LIMIT, MODELLED
from moodfeed.sources.fixtures import AS_OF_YEAR, DAY_MS, DECORATIONS, FIRST_MS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


SPACE = f"[{lx.SPACES}]"
# that may stand before or after an entity
EDGE_MARKS = '.,!?:;"'

# --- inputs -----------------------------------------------------------------

_DECORATION = " ".join(f"WHEN {i} THEN {text(d)}" for i, d in enumerate(DECORATIONS))

PARTS: dict[str, str] = {}

# the language whose rules hold
_CODE = f"CASE WHEN lang IN {in_list(lx.NEGATION_WORDS)} THEN lang ELSE 'en' END"
_WORD_OF_CODE = "CASE code " + " ".join(
    f"WHEN '{code}' THEN {text(word)}" for code, word in lx.NEGATION_WORDS.items()
) + " END"

PARTS["lines"] = """
  SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
         unnest(string_split(text, chr(10))) AS line
  FROM documents"""

PARTS["tweets"] = f"""
  SELECT doc_id * 100000 + pos AS tweet_id, lang,
         concat(line, CASE (doc_id * 7 + pos) % 16 {_DECORATION} END) AS text,
         {FIRST_MS} + ((doc_id * 7 + pos) % 1500) * {DAY_MS} AS ts_ms
  FROM lines WHERE length(line) > 0"""

# the backup after parsing: missing keys are NULL
PARTS["parsed"] = """
  SELECT tweet_id, text, CASE WHEN tweet_id % 11 <> 0 THEN lang END AS lang,
         CASE WHEN tweet_id % 13 <> 0 THEN ts_ms END AS ts_ms
  FROM tweets"""

PARTS["emoticon_tweets"] = f"""
  SELECT DISTINCT tweet_id
  FROM (SELECT tweet_id, unnest(string_split_regex(text, '{SPACE}+')) AS w FROM tweets)
  WHERE w IN {in_list(lx.COLLECT_EMOTICONS)}"""

PARTS["collected"] = f"""
  SELECT tweet_id, lang, text FROM parsed SEMI JOIN emoticon_tweets USING (tweet_id)
  WHERE lang = '{COLLECT_LANG}'
    AND abs(year(make_timestamp(ts_ms * 1000)) - {AS_OF_YEAR}) <= 1"""


def pipeline(source: str, prefix: str = "", by_language: bool = False) -> None:
    """From a table ``tweet_id, lang, text`` to processed tweets and their terms."""
    p = prefix
    if by_language:
        stop = " OR ".join(
            f"(code = '{code}' AND w IN {in_list(lx.stopwords(code))})" for code in lx.NEGATION_WORDS
        )
        words = f"(SELECT w.*, {_CODE} AS code FROM {p}words w JOIN {source} s USING (tweet_id))"
        kept_from = f"{words} WHERE NOT ({stop}) AND NOT starts_with(w, 'RT')"
        kept_columns, negation = "tweet_id, code, w", _WORD_OF_CODE
    else:
        kept_from = (
            f"{p}words WHERE w NOT IN {in_list(lx.stopwords())} AND NOT starts_with(w, 'RT')"
        )
        kept_columns, negation = "tweet_id, w", "'not'"
    PARTS[f"{p}chars"] = f"""
  SELECT tweet_id, unnest(string_split(lower(text), '')) AS ch,
         generate_subscripts(string_split(lower(text), ''), 1) AS i
  FROM {source}"""
    PARTS[f"{p}runs"] = f"""
  SELECT tweet_id, ch, min(i) AS i, count(*) AS n
  FROM (SELECT tweet_id, ch, i, i - row_number() OVER (PARTITION BY tweet_id, ch ORDER BY i) AS g
        FROM {p}chars)
  GROUP BY tweet_id, ch, g"""
    PARTS[f"{p}normal"] = f"""
  SELECT s.tweet_id, s.lang, coalesce(r.text, '') AS text, coalesce(r.rep_count, 0) AS rep_count
  FROM {source} s LEFT JOIN (
    SELECT tweet_id, string_agg(repeat(ch, least(n, 2)::INT), '' ORDER BY i) AS text,
           count(*) FILTER (n >= 3) AS rep_count
    FROM {p}runs GROUP BY tweet_id) r USING (tweet_id)"""
    PARTS[f"{p}words"] = f"""
  SELECT * FROM (
    SELECT tweet_id, unnest(string_split_regex(text, '{SPACE}+')) AS w,
           generate_subscripts(string_split_regex(text, '{SPACE}+'), 1) AS i
    FROM {p}normal)
  WHERE w <> ''"""
    PARTS[f"{p}kept"] = f"""
  SELECT {kept_columns}, row_number() OVER (PARTITION BY tweet_id ORDER BY i) AS i,
         count(*) OVER (PARTITION BY tweet_id) AS n
  FROM {kept_from}"""
    # odd places in a run of "not" negate
    PARTS[f"{p}negators"] = f"""
  SELECT tweet_id, i,
         row_number() OVER (PARTITION BY tweet_id, g ORDER BY i) % 2 = 1 AS active
  FROM (SELECT tweet_id, i, i - row_number() OVER (PARTITION BY tweet_id ORDER BY i) AS g
        FROM {p}kept WHERE w = {negation})"""
    PARTS[f"{p}marked"] = f"""
  SELECT tweet_id, i, active,
         CASE WHEN lag(active) OVER t THEN {negation} || '___' || w
              WHEN active AND i < n THEN '' ELSE w END AS w
  FROM (SELECT k.*, coalesce(g.active, false) AS active
        FROM {p}kept k LEFT JOIN {p}negators g USING (tweet_id, i))
  WINDOW t AS (PARTITION BY tweet_id ORDER BY i)"""
    PARTS[f"{p}referenced"] = f"""
  SELECT tweet_id, i, CASE WHEN starts_with(w, '@') OR starts_with(w, '.@') THEN '___mention___'
                           WHEN starts_with(w, 'http') OR starts_with(w, 'www') THEN '___url___'
                           ELSE w END AS w
  FROM {p}marked"""
    PARTS[f"{p}corpora"] = f"""
  SELECT s.tweet_id, s.lang, coalesce(c.corpus, '') AS corpus
  FROM {source} s LEFT JOIN (
    SELECT tweet_id,
           string_agg(translate(w, {text(lx.STRIPPED_PUNCTUATION)}, ''), ' ' ORDER BY i) AS corpus
    FROM {p}referenced WHERE length(w) > 2 GROUP BY tweet_id) c USING (tweet_id)"""
    positive, negative = lx.emoticons()
    PARTS[f"{p}features"] = f"""
  SELECT tweet_id, count(*) FILTER (starts_with(w, '#')) AS hashtag_count,
         count(*) FILTER (starts_with(w, '!')) AS exclam_count,
         count(*) FILTER (starts_with(w, '?')) AS question_count,
         count(*) FILTER (active) AS negation_count, count(*) AS token_count,
         arg_min(CASE WHEN w IN {in_list(positive)} THEN 1 ELSE -1 END, i)
           FILTER (w IN {in_list([*positive, *negative])}) AS label
  FROM {p}marked GROUP BY tweet_id"""
    filled = ", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in COUNTS[1:])
    PARTS[f"{p}processed"] = f"""
  SELECT c.tweet_id, c.lang, c.corpus, n.rep_count, {filled}, f.label
  FROM {p}corpora c JOIN {p}normal n USING (tweet_id) LEFT JOIN {p}features f USING (tweet_id)"""
    PARTS[f"{p}corpus_words"] = f"""
  SELECT tweet_id, lang, w, row_number() OVER (PARTITION BY tweet_id ORDER BY i) AS i
  FROM (SELECT tweet_id, lang, unnest(string_split_regex(corpus, '{SPACE}+')) AS w,
               generate_subscripts(string_split_regex(corpus, '{SPACE}+'), 1) AS i
        FROM {p}corpora)
  WHERE w <> ''"""
    PARTS[f"{p}grams"] = f"""
  SELECT tweet_id, lang, w AS term FROM {p}corpus_words
  UNION ALL
  SELECT a.tweet_id, a.lang, a.w || ' ' || b.w
  FROM {p}corpus_words a JOIN {p}corpus_words b ON a.tweet_id = b.tweet_id AND b.i = a.i + 1"""
    PARTS[f"{p}terms"] = f"SELECT DISTINCT tweet_id, lang, term FROM {p}grams"


pipeline("tweets")
pipeline("turns", "turn_")
pipeline("parsed", "par_")
pipeline("localized", "loc_", by_language=True)

PARTS["localized"] = f"""
  SELECT tweet_id, lang, replace(text, ' not', ' ' || {_WORD_OF_CODE}) AS text
  FROM (SELECT *, {_CODE} AS code FROM parsed)"""

PARTS["turns"] = """
  SELECT conv_id * 1000 + turn AS tweet_id, 'en' AS lang, text FROM conversations"""

PARTS["vocabulary"] = """
  SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY term) - 1 AS term_id, df, n_docs,
         ln((1 + n_docs) / (1 + df)) + 1 AS idf
  FROM (SELECT lang, term, count(*) AS df FROM terms GROUP BY lang, term)
  JOIN (SELECT lang, count(*) AS n_docs FROM tweets GROUP BY lang) USING (lang)"""

PARTS["vocabulary_all"] = """
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, n_docs,
         ln((1 + n_docs) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM terms GROUP BY term)
  CROSS JOIN (SELECT count(*) AS n_docs FROM tweets)"""


def _tfidf(terms: str) -> str:
    return f"""
  SELECT tweet_id, lang, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY tweet_id)) AS tfidf
  FROM {terms} JOIN vocabulary USING (lang, term)"""


PARTS["tfidf"] = _tfidf("terms")
PARTS["turn_tfidf"] = _tfidf("turn_terms")

_SCALED = ", ".join(
    f"({c} - avg({c}) OVER l) / CASE WHEN stddev_pop({c}) OVER l = 0 THEN 1 "
    f"ELSE stddev_pop({c}) OVER l END AS {c}"
    for c in COUNTS
)
PARTS["scaled"] = f"""
  SELECT tweet_id, lang, {_SCALED} FROM processed WINDOW l AS (PARTITION BY lang)"""

PARTS["matrix"] = "SELECT tweet_id, term AS feature, tfidf AS value FROM tfidf" + "".join(
    f" UNION ALL SELECT tweet_id, '{c}', {c} FROM scaled" for c in COUNTS
)

PARTS["term_margins"] = """
  SELECT tweet_id, sum(idf * (length(term) % 5 - 2) / 10) / sqrt(sum(idf * idf)) AS margin
  FROM terms JOIN vocabulary USING (lang, term) GROUP BY tweet_id"""

PARTS["par_vocabulary"] = """
  SELECT d.lang, term, df, ln((1 + n_docs) / (1 + df)) + 1 AS idf
  FROM (SELECT lang, term, count(*) AS df FROM par_terms GROUP BY lang, term) d
  JOIN (SELECT lang, count(*) AS n_docs FROM parsed GROUP BY lang) n
    ON d.lang IS NOT DISTINCT FROM n.lang"""

PARTS["par_entries"] = """
  SELECT t.tweet_id, t.term, v.idf FROM par_terms t
  JOIN par_vocabulary v ON t.term = v.term AND t.lang IS NOT DISTINCT FROM v.lang"""

PARTS["par_margins"] = """
  SELECT tweet_id, sum(idf * (length(term) % 5 - 2) / 10) / sqrt(sum(idf * idf)) AS margin
  FROM par_entries GROUP BY tweet_id"""

PARTS["par_scaled"] = f"""
  SELECT tweet_id, lang, {_SCALED} FROM par_processed WINDOW l AS (PARTITION BY lang)"""

PARTS["par_scores"] = f"""
  SELECT tweet_id, lang, CASE WHEN lang IN {in_list(MODELLED)} THEN 0.1::DOUBLE + coalesce(margin, 0)
    + {' + '.join(f'{c} * {k - 2} / 10' for k, c in enumerate(COUNTS))} END AS m
  FROM par_scaled LEFT JOIN par_margins USING (tweet_id)"""

# Logistic regression on the six scaled counts, a model per language: Newton steps, each a sum over the
# training rows and the elimination of a system of seven equations.
INPUTS = ["bias", *COUNTS]
STEPS = 40

pipeline("tweets", "own_", by_language=True)

PARTS["own_scaled"] = f"""
  SELECT tweet_id, lang, label, 1.0::DOUBLE AS bias, {_SCALED}
  FROM own_processed WINDOW l AS (PARTITION BY lang)"""

PARTS["own_rows"] = """
  SELECT *, (label + 1) / 2 AS y, row_number() OVER (PARTITION BY lang ORDER BY tweet_id)
         <= floor(0.7::DOUBLE * count(*) OVER (PARTITION BY lang)) AS in_train
  FROM own_scaled WHERE label IS NOT NULL AND lang IS NOT NULL"""


def _margin(row: str, state: str) -> str:
    return " + ".join(f"{row}.{c} * {state}.w{i}" for i, c in enumerate(INPUTS))


def _newton_step() -> str:
    """One step of every language: lang, i and the weights."""
    size = len(INPUTS)
    sums = [f"sum(p * (1 - p) * {a} * {b}) AS a{i}_{j}" for i, a in enumerate(INPUTS)
            for j, b in enumerate(INPUTS) if i <= j]
    sums += [f"sum((y - p) * {a}) AS b{i}" for i, a in enumerate(INPUTS)]
    weights = ", ".join(f"any_value(w{i}) AS w{i}" for i in range(size))
    held = ", ".join(f"w{i}" for i in range(size))
    body = f"""SELECT lang, any_value(i) AS i, {weights}, {', '.join(sums)}
      FROM (SELECT r.*, s.i, {', '.join(f's.w{i}' for i in range(size))},
                   1 / (1 + exp(-({_margin('r', 's')}))) AS p
            FROM own_rows r JOIN fit s ON r.lang = s.lang WHERE in_train AND s.i < {STEPS})
      GROUP BY lang"""
    # the penalty, not on the bias
    cells = [f"a{min(i, j)}_{max(i, j)} + {int(i == j > 0)} AS m{i}_{j}" for i in range(size) for j in range(size)]
    cells += [f"b{i} - {int(i > 0)} * w{i} AS m{i}_{size}" for i in range(size)]
    body = f"SELECT lang, i, {held}, {', '.join(cells)} FROM ({body})"
    for k in range(size):
        cells = []
        for i in range(size):
            for j in range(k + 1, size + 1):
                cells.append(
                    f"m{k}_{j} / m{k}_{k} AS m{k}_{j}" if i == k
                    else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} AS m{i}_{j}"
                )
        body = f"SELECT lang, i, {held}, {', '.join(cells)} FROM ({body})"
    moved = ", ".join(f"w{i} + m{i}_{size}" for i in range(size))
    return f"SELECT lang, i + 1, {moved} FROM ({body})"


_ZEROS = ", ".join(f"0.0::DOUBLE AS w{i}" for i in range(len(INPUTS)))
PARTS["fit"] = f"""
  SELECT DISTINCT lang, 0 AS i, {_ZEROS} FROM own_rows WHERE in_train
  UNION ALL
  {_newton_step()}"""

PARTS["own_scored"] = f"""
  SELECT tweet_id, r.lang, label, {_margin('r', 's')} AS m
  FROM own_rows r JOIN fit s ON r.lang = s.lang WHERE NOT in_train AND s.i = {STEPS}"""

PARTS["own_classes"] = """
  SELECT lang, c.class, count(*) FILTER (label = class AND (m > 0) = (class = 1)) AS tp,
         count(*) FILTER ((m > 0) = (class = 1)) AS predicted, count(*) FILTER (label = class) AS actual
  FROM own_scored, (VALUES (1), (-1)) c(class) GROUP BY ALL"""

PARTS["ratings"] = "SELECT quality AS y_true, 1 - toxic AS y_pred FROM labels"

PARTS["class_scores"] = """
  SELECT class, count(*) FILTER (y_true = class AND y_pred = class) AS tp,
         count(*) FILTER (y_pred = class) AS predicted, count(*) FILTER (y_true = class) AS actual
  FROM ratings JOIN (SELECT y_true AS class FROM ratings UNION SELECT y_pred FROM ratings)
    ON y_true = class OR y_pred = class
  GROUP BY class"""


def names_in(sql: str) -> list[str]:
    import re

    words = set(re.findall(r"[a-z_]+", re.sub(r"'(?:[^']|'')*'", "''", sql)))
    return [n for n in PARTS if n in words]


def query(body: str) -> str:
    """The body after the parts it needs, in order of their dependence."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in names_in(PARTS[name]):
            if other != name:
                add(other)
        if name not in order:
            order.append(name)

    for name in names_in(body):
        add(name)
    if not order:
        return body
    # the one that refers to itself cannot be materialized at once
    kept = {n: "AS" if n in names_in(PARTS[n]) else "AS MATERIALIZED" for n in order}
    parts = ",\n".join(f"{n} {kept[n]} ({PARTS[n]})" for n in order)
    return f"WITH {'RECURSIVE ' * ('AS' in kept.values())}{parts}\n{body}"


def tokens_of(part: str, column: str = "tokens", separator: str = " ") -> str:
    return (
        f"SELECT tweet_id, coalesce({column}, '') AS tokens FROM tweets LEFT JOIN (SELECT tweet_id, "
        f"string_agg(w, '{separator}' ORDER BY i) AS {column} FROM {part} GROUP BY tweet_id) "
        "USING (tweet_id)"
    )


def count_of(name: str) -> str:
    return f"SELECT tweet_id, {name} FROM processed"


def squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SPACE}+', ' ', 'g'))"


_VOCABULARY = "SELECT lang, term, term_id, df, n_docs, round(idf, 6) AS idf FROM vocabulary"
_TFIDF = "SELECT tweet_id, term, round(tfidf, 6) AS tfidf FROM tfidf"

_EDGE = "['\"“”‘’«»{}()\\[\\]*&]".replace("'", "''")
_LIMIT = f"[:;.,{lx.SPACES}]"
_EDGES = (
    f"regexp_replace(regexp_replace(text, '(^|{_LIMIT})({_EDGE}+)([a-zA-Z0-9])', '\\1\\2 \\3', 'g'),"
    f" '([a-zA-Z0-9])({_EDGE}+)({_LIMIT}|$)', '\\1 \\2\\3', 'g')"
)

_ENDING = f"({lx.CONTRACTION_ENDINGS})$".replace("'", "''")
_CONTRACTED = f"(?i)([\\p{{L}}\\p{{N}}_]+){_ENDING}"

_BODIES = {
    "read_backup_json": "SELECT lang, text, ts_ms FROM parsed",
    "read_polarity_csv": "SELECT tweet_id, (tweet_id % 3) * 2 AS target, text FROM tweets",
    "corpus_roundtrip": "SELECT tweet_id, lang, text FROM tweets",
    "vocab_roundtrip": _VOCABULARY,
    "tfidf_roundtrip": _TFIDF,
    "collect_lang_filter": f"SELECT tweet_id, lang FROM parsed WHERE lang = '{COLLECT_LANG}'",
    "collect_emoticon_filter": "SELECT tweet_id, text FROM tweets SEMI JOIN emoticon_tweets "
    "USING (tweet_id)",
    "collect_timestamp": "SELECT tweet_id, strftime(make_timestamp(ts_ms * 1000), "
    "'%Y-%m-%d %H:%M:%S') AS posted_at FROM parsed",
    "collect_year_window": "SELECT tweet_id, year(make_timestamp(ts_ms * 1000)) AS year FROM parsed "
    f"WHERE abs(year(make_timestamp(ts_ms * 1000)) - {AS_OF_YEAR}) <= 1",
    "collect_limit": f"SELECT tweet_id, text FROM tweets ORDER BY tweet_id LIMIT {COLLECT_LIMIT}",
    "collect_tweets": f"SELECT * FROM collected ORDER BY tweet_id LIMIT {COLLECT_LIMIT}",
    "collect_all_tweets": "SELECT * FROM collected",
    "polarity_labels": "SELECT tweet_id, CASE tweet_id % 3 WHEN 2 THEN 1 ELSE -1 END AS label, text "
    "FROM tweets WHERE tweet_id % 3 <> 1",
    "elongation": "SELECT tweet_id, text, rep_count FROM normal",
    "squeeze_whitespace": f"SELECT tweet_id, {squeezed('text')} AS text FROM tweets",
    "split_edge_punct": f"SELECT tweet_id, {_EDGES} AS text FROM normal",
    "tokenize_twitter": f"SELECT tweet_id, regexp_replace(text, '{SPACE}+', '', 'g') AS tokens "
    "FROM normal",
    "tokenize_raw": f"SELECT tweet_id, regexp_replace(replace(text, '&amp;', '&'), '{SPACE}+', '', "
    "'g') AS tokens FROM tweets",
    "split_contractions": f"""
  SELECT tweet_id, coalesce(tokens, '') AS tokens FROM tweets LEFT JOIN (
    SELECT tweet_id, string_agg(
      CASE WHEN regexp_matches(w, '{_CONTRACTED}')
           THEN regexp_extract(w, '{_CONTRACTED}', 1) || ' ' || regexp_extract(w, '{_CONTRACTED}', 2)
           ELSE w END, ' ' ORDER BY i) AS tokens
    FROM (SELECT tweet_id, i, w || CASE (row_number() OVER (PARTITION BY tweet_id ORDER BY i) - 1) % 8
            WHEN 1 THEN 'n''t' WHEN 2 THEN '''ve' WHEN 3 THEN '''ll' WHEN 4 THEN '''d'
            WHEN 5 THEN '''re' WHEN 6 THEN '''s' WHEN 7 THEN '''m' ELSE '' END AS w
          FROM words)
    GROUP BY tweet_id) USING (tweet_id)""",
    "hashtag_mention_counts": """
  SELECT CASE WHEN token[1] = '#' THEN 'hashtag' ELSE 'mention' END AS kind, token, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(text, '(?:^|[ (])([#@][a-z0-9_]+)', 1)) AS token
        FROM normal)
  GROUP BY ALL""",
    # shapes of whole runs between spaces, without the marks at their edges; of two per cent signs a number
    # keeps one
    "entity_tokens": f"""
  SELECT kind, token, count(*) AS n FROM (
    SELECT token, CASE
      WHEN regexp_full_match(token, 'https?://.+') THEN 'url'
      WHEN regexp_full_match(token, '(?:[a-z0-9-]+[.]){{1,4}}(?:{"|".join(lx.GENERIC_DOMAINS)})(?:/.*)?') THEN 'url'
      WHEN regexp_full_match(token, '[a-z0-9._%+-]+@(?:[a-z0-9-]+[.])+[a-z]{{2,4}}') THEN 'email'
      WHEN regexp_full_match(token, '[0-9]+(?::[0-9]+){{1,2}}') THEN 'time'
      WHEN regexp_full_match(token, '[$€£¥]?[0-9]+(?:[.][0-9]+)+%?') THEN 'number'
      WHEN regexp_full_match(token, '#[a-z0-9_]+') THEN 'hashtag'
      WHEN regexp_full_match(token, '@[a-z0-9_]+') THEN 'mention' END AS kind
    FROM (SELECT regexp_replace(regexp_replace(regexp_replace(
                   w, '^[({EDGE_MARKS}]+|[){EDGE_MARKS}&#*$]+$', '', 'g'),
                   '([.0-9])%%$', '\\1%'), '([a-z])%%$', '\\1') AS token
          FROM (SELECT unnest(string_split(text, ' ')) AS w FROM normal)))
  WHERE kind IS NOT NULL GROUP BY ALL""",
    "stopword_filter": tokens_of("kept"),
    "retweet_filter": tokens_of("(SELECT * FROM words WHERE NOT starts_with(w, 'rt'))"),
    "tokenize_whitespace": f"SELECT tweet_id, {squeezed('text')} AS tokens FROM tweets",
    "negation_scope": tokens_of("marked"),
    "negation_count": count_of("negation_count"),
    "mention_normalize": tokens_of(
        "(SELECT tweet_id, i, CASE WHEN starts_with(w, '@') OR starts_with(w, '.@') "
        "THEN '___mention___' ELSE w END AS w FROM marked)"
    ),
    "url_normalize": tokens_of(
        "(SELECT tweet_id, i, CASE WHEN starts_with(w, 'http') OR starts_with(w, 'www') "
        "THEN '___url___' ELSE w END AS w FROM marked)"
    ),
    "exclamation_count": count_of("exclam_count"),
    "question_count": count_of("question_count"),
    "hashtag_count": count_of("hashtag_count"),
    "token_count": count_of("token_count"),
    "emoticon_label": count_of("label::BIGINT AS label"),
    "distant_label_counts": "SELECT lang, label::BIGINT AS label, count(*) AS n FROM processed "
    "GROUP BY ALL",
    "corpus_normalize": "SELECT tweet_id, corpus FROM corpora",
    "process_tweets": f"SELECT tweet_id, lang, corpus, {', '.join(COUNTS)}, label::BIGINT AS label "
    "FROM processed",
    "ngrams": "SELECT tweet_id, term FROM grams",
    "document_frequency": "SELECT lang, term, df FROM vocabulary",
    "idf_fit": "SELECT term, term_id, df, n_docs, round(idf, 6) AS idf FROM vocabulary_all",
    "idf_per_language": _VOCABULARY,
    "tfidf_fit_transform": _TFIDF,
    "tfidf_transform": "SELECT tweet_id, term, round(tfidf, 6) AS tfidf FROM turn_tfidf",
    "scale_features": "SELECT tweet_id, "
    + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in COUNTS)
    + " FROM scaled",
    "feature_matrix": "SELECT tweet_id, feature, round(value, 6) + 0.0 AS value FROM matrix",
    "clear_unlabeled": "SELECT tweet_id, label::BIGINT AS label, count(*) AS n_entries "
    "FROM matrix JOIN processed USING (tweet_id) WHERE label IS NOT NULL GROUP BY ALL",
    "split_positional": """
  SELECT tweet_id, label::BIGINT AS label,
         CASE WHEN row_number() OVER (ORDER BY tweet_id) <= floor(0.7::DOUBLE * count(*) OVER ())
              THEN 'train' ELSE 'test' END AS part
  FROM processed WHERE label IS NOT NULL""",
    "linear_score": "SELECT tweet_id, round(margin, 6) + 0.0 AS margin, "
    "round(1 / (1 + exp(-margin)), 6) AS probability FROM term_margins",
    "metric_accuracy": "SELECT round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM ratings",
    "metric_macro_f1": """
  SELECT round(avg(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END), 6) AS macro_precision,
         round(avg(CASE WHEN actual = 0 THEN 0 ELSE tp / actual END), 6) AS macro_recall,
         round(avg(2 * tp / (predicted + actual)), 6) AS macro_f1
  FROM class_scores""",
    "metric_auc_hard": """
  SELECT round((avg((y_pred = 1)::INT) FILTER (y_true = 1)
                + avg((y_pred <> 1)::INT) FILTER (y_true <> 1)) / 2, 6) AS roc_auc
  FROM ratings""",
    # ranks with ties averaged
    "metric_auc_score": """
  SELECT lang, p AS n_positive, n AS n_negative,
         CASE WHEN p > 0 AND n > 0 THEN round((rank_sum - p * (p + 1) / 2) / (p * n), 6) END AS roc_auc
  FROM (SELECT lang, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n,
               coalesce(sum(mean_rank) FILTER (label = 1), 0) AS rank_sum
        FROM (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score)
                     + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS mean_rank
              FROM (SELECT s.lang, label, round(m, 6) + 0.0 AS score
                    FROM par_scores s JOIN par_processed USING (tweet_id)
                    WHERE m IS NOT NULL AND label IS NOT NULL))
        GROUP BY lang)""",
    "metric_report": """
  SELECT (SELECT count(*) FROM ratings) AS n,
         (SELECT round(avg((y_true = y_pred)::INT), 6) FROM ratings) AS accuracy,
         (SELECT round(avg(2 * tp / (predicted + actual)), 6) FROM class_scores) AS macro_f1,
         (SELECT round((avg((y_pred = 1)::INT) FILTER (y_true = 1)
                        + avg((y_pred <> 1)::INT) FILTER (y_true <> 1)) / 2, 6)
          FROM ratings) AS roc_auc""",
    "stream_collect": "SELECT tweet_id, lang, text FROM collected",
    "score_all_languages": """
  SELECT tweet_id, lang, round(m, 6) + 0.0 AS margin,
         round(1 / (1 + exp(-m)), 6) AS probability,
         CASE WHEN m > 0 THEN 1 WHEN m IS NOT NULL THEN -1 END::BIGINT AS prediction
  FROM par_scores""",
    "feature_matrix_all_languages": """
  SELECT tweet_id, term AS feature,
         round(idf / sqrt(sum(idf * idf) OVER (PARTITION BY tweet_id)), 6) AS value
  FROM par_entries"""
    + "".join(
        f" UNION ALL SELECT tweet_id, '{c}', round({c}, 6) + 0.0 FROM par_scaled" for c in COUNTS
    ),
    "process_tweets_by_language": "SELECT tweet_id, lang, corpus, "
    + ", ".join(COUNTS)
    + ", label::BIGINT AS label FROM loc_processed",
    # a minimum: no slope is left
    "lr_gradient": "SELECT lang, 0.0::DOUBLE AS largest FROM processed WHERE label IS NOT NULL "
    "GROUP BY lang",
    "stream_score": f"""
  SELECT tweet_id, round(m, 6) + 0.0 AS margin, round(1 / (1 + exp(-m)), 6) AS probability,
         CASE WHEN m > 0 THEN 1 ELSE -1 END::BIGINT AS prediction
  FROM (SELECT tweet_id, 0.1::DOUBLE + coalesce(margin, 0)
               + {' + '.join(f'{c} * {k - 2} / 10' for k, c in enumerate(COUNTS))} AS m
        FROM scaled LEFT JOIN term_margins USING (tweet_id))""",
}


_BODIES["lr_fit_counts"] = " UNION ALL ".join(
    f"SELECT lang, '{c}' AS input, round(w{i}, 3) + 0.0 AS weight FROM fit WHERE i = {STEPS}"
    for i, c in enumerate(INPUTS)
)
_BODIES["lr_predict_counts"] = """
  SELECT tweet_id, lang, label::BIGINT AS label, round(m, 2) + 0.0 AS margin,
         round(1 / (1 + exp(-m)), 3) AS probability, CASE WHEN m > 0 THEN 1 ELSE -1 END::BIGINT AS prediction
  FROM own_scored"""
_BODIES["experiment_counts"] = """
  SELECT s.lang, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
         round(roc_auc, 6) AS roc_auc, round(roc_auc_score, 6) AS roc_auc_score
  FROM (SELECT lang, count(*) AS n, avg(((m > 0) = (label = 1))::INT) AS accuracy FROM own_scored GROUP BY lang) s
  JOIN (SELECT lang, avg(2 * tp / nullif(predicted + actual, 0)) AS macro_f1,
               CASE WHEN min(actual) > 0 THEN avg(tp / actual) END AS roc_auc
        FROM own_classes GROUP BY lang) c USING (lang)
  JOIN (SELECT lang, CASE WHEN p > 0 AND p < n THEN (rank_sum - p * (p + 1) / 2) / (p * (n - p)) END AS roc_auc_score
        FROM (SELECT lang, count(*) FILTER (label = 1) AS p, count(*) AS n,
                     coalesce(sum(mean_rank) FILTER (label = 1), 0) AS rank_sum
              FROM (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score)
                           + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS mean_rank
                    FROM (SELECT lang, label, round(m, 6) AS score FROM own_scored))
              GROUP BY lang)) a USING (lang)"""

# vectors hold what the long form holds
_BODIES["feature_vectors_all_languages"] = _BODIES["feature_matrix_all_languages"]


def oracle_sql() -> dict[str, str]:
    return {name: query(body) for name, body in _BODIES.items()}
