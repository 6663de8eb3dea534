"""The same queries as plain SQL over the given tables, to check the results."""

from __future__ import annotations

from wrenlight.functions import text as tx
from wrenlight.operators.select import BEST_BIGRAMS, BEST_WORDS_THREE, BEST_WORDS_TWO
from wrenlight.plans.table_queries import STOPWORDS, TOPIC, WORDS_CUT


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TOKENS = f"regexp_extract_all(text, {_quote(tx.TOKEN)})"
_WORDS = f"regexp_extract_all(lower(text), {_quote(tx.TERM)})"
_NO_HANDLE = f"NOT regexp_matches(token, {_quote(tx.HANDLE_TOKEN)})"
_TOPIC = f"regexp_matches(text, {_quote(TOPIC)})"

_LABELLED = """
labelled AS (
  SELECT d.doc_id, d.text,
         CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 4 ELSE 2 END AS polarity
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _replace(text: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        text = f"regexp_replace({text}, {_quote(pattern)}, '{new}', 'g')"
    return text


def _chi(n_ii: str, n_ix: str, n_xi: str, n_xx: str) -> str:
    a, x, y, n = (f"CAST({v} AS DOUBLE)" for v in (n_ii, n_ix, n_xi, n_xx))
    top = f"({a} * ({n} - {x} - {y} + {a}) - ({x} - {a}) * ({y} - {a}))"
    bottom = f"({x} * {y} * ({n} - {y}) * ({n} - {x}))"
    return f"CASE WHEN {bottom} = 0 THEN 0.0 ELSE {n} * {top} * {top} / {bottom} END"


def _best_three(source: str, name: str = "best") -> str:
    """CTEs ending in the best words of three classes of ``source``."""
    return f"""
{name}_tokens AS (
  SELECT polarity, lower(token) AS token
  FROM (SELECT polarity, unnest({_TOKENS}) AS token FROM {source}) WHERE {_NO_HANDLE}),
{name}_counts AS (
  SELECT token, count(*) AS n, count(*) FILTER (polarity = 4) AS n_pos,
         count(*) FILTER (polarity = 2) AS n_neutral,
         count(*) FILTER (polarity NOT IN (2, 4)) AS n_neg
  FROM {name}_tokens GROUP BY token),
{name}_totals AS (
  SELECT sum(n) AS t, sum(n_pos) AS t_pos, sum(n_neutral) AS t_neutral, sum(n_neg) AS t_neg
  FROM {name}_counts),
{name}_scores AS (
  SELECT token, n, round({_chi("n_pos", "n", "t_pos", "t")}
    + {_chi("n_neutral", "n", "(t_neutral + 1)", "t")} + {_chi("n_neg", "n", "t_neg", "t")}, 6) AS score
  FROM {name}_counts, {name}_totals),
{name} AS (SELECT * FROM {name}_scores ORDER BY score DESC, token LIMIT {BEST_WORDS_THREE})"""


_BEST_TWO = f"""
two_tokens AS (
  SELECT polarity, lower(token) AS token
  FROM (SELECT polarity, unnest({_TOKENS}) AS token FROM labelled)),
two_counts AS (
  SELECT token, count(*) AS n, count(*) FILTER (polarity = 0) AS n_neg,
         count(*) FILTER (polarity <> 0) AS n_pos
  FROM two_tokens GROUP BY token),
two_totals AS (SELECT sum(n) AS t, sum(n_neg) AS t_neg, sum(n_pos) AS t_pos FROM two_counts),
two_scores AS (
  SELECT token, n, round({_chi("n_neg", "n", "t_neg", "t")} + {_chi("n_pos", "n", "t_pos", "t")}, 6)
    AS score FROM two_counts, two_totals),
best_two AS (SELECT * FROM two_scores ORDER BY score DESC, token LIMIT {BEST_WORDS_TWO})"""

_BEST_BIGRAMS = f"""
lists AS (SELECT {_TOKENS} AS t FROM documents),
unigrams AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM lists) GROUP BY 1),
pairs AS (
  SELECT unnest(list_zip(t[1:len(t) - 1], t[2:len(t)])) AS p FROM lists WHERE len(t) > 1),
pair_counts AS (SELECT p[1] AS w1, p[2] AS w2, count(*) AS n FROM pairs GROUP BY 1, 2),
pair_scores AS (
  SELECT c.w1, c.w2, c.n,
         round({_chi("c.n", "a.n", "b.n", "(SELECT sum(n) FROM unigrams)")}, 6) AS score
  FROM pair_counts c JOIN unigrams a ON c.w1 = a.token JOIN unigrams b ON c.w2 = b.token),
best_bigrams AS (SELECT * FROM pair_scores ORDER BY score DESC, w1, w2 LIMIT {BEST_BIGRAMS})"""


def _presence(train: str, test: str, key: str = "doc_id") -> str:
    """CTEs of the presence model fitted on ``train``, ending in ``predicted`` for ``test``."""
    return f"""{_best_three(train)},
fit_rows AS (
  SELECT DISTINCT doc_id, polarity, token
  FROM (SELECT doc_id, polarity, unnest({_TOKENS}) AS token FROM {train})
  WHERE {_NO_HANDLE} AND token IN (SELECT token FROM best)),
classes AS (
  SELECT polarity, CASE polarity WHEN 4 THEN 'pos' WHEN 2 THEN 'neutral' ELSE 'neg' END AS label,
         count(*) AS size, sum(count(*)) OVER () AS total, count(*) OVER () AS labels
  FROM {train} GROUP BY polarity),
fit_tokens AS (SELECT token, count(*) AS n FROM fit_rows GROUP BY token),
fit_counts AS (SELECT token, polarity, count(*) AS c FROM fit_rows GROUP BY token, polarity),
model AS (
  SELECT t.token, k.label, coalesce(c.c, 0) AS c, k.size,
         0.5 * CASE WHEN t.n = k.total THEN 1 ELSE 2 END AS half_bins
  FROM fit_tokens t CROSS JOIN classes k
  LEFT JOIN fit_counts c ON c.token = t.token AND c.polarity = k.polarity),
test_rows AS (
  SELECT DISTINCT {key}, token FROM (SELECT {key}, unnest({_TOKENS}) AS token FROM {test})
  WHERE {_NO_HANDLE}),
sums AS (
  SELECT r.{key}, m.label, sum(ln((m.c + 0.5) / (m.size + m.half_bins))) AS s
  FROM test_rows r JOIN model m ON r.token = m.token GROUP BY 1, 2),
ranked AS (
  SELECT x.{key}, k.label, row_number() OVER (
    PARTITION BY x.{key} ORDER BY round(ln((k.size + 0.5) / (k.total + 0.5 * k.labels))
      + coalesce(s.s, 0), 6) DESC, k.label DESC) AS place
  FROM {test} x CROSS JOIN classes k LEFT JOIN sums s ON s.{key} = x.{key} AND s.label = k.label),
predicted AS (SELECT {key}, label AS prediction FROM ranked WHERE place = 1)"""


def _split(source: str, where: str) -> str:
    return f"""
placed AS (
  SELECT *, row_number() OVER (PARTITION BY polarity ORDER BY doc_id) - 1 AS place,
         count(*) OVER (PARTITION BY polarity) AS size FROM {source} WHERE {where}),
parts AS (
  SELECT *, CASE WHEN place < floor(CAST(0.6 AS DOUBLE) * size) THEN 'train'
                 WHEN place < floor(CAST(0.8 AS DOUBLE) * size) THEN 'val' ELSE 'test' END AS part
  FROM placed)"""


_HELD_OUT = f"""{_LABELLED},{_split("labelled", "true")},
train AS (SELECT doc_id, text, polarity FROM parts WHERE part = 'train'),
held AS (SELECT doc_id, text, polarity FROM parts WHERE part = 'val'),{_presence("train", "held")},
outcome AS (
  SELECT h.doc_id, CASE polarity WHEN 4 THEN 'pos' WHEN 2 THEN 'neutral' ELSE 'neg' END AS label,
         p.prediction FROM held h JOIN predicted p ON h.doc_id = p.doc_id)"""


def _sides(source: str) -> str:
    return f"""
sides AS (
  SELECT c AS label, sum(tp) AS tp, sum(actual) AS actual, sum(guessed) AS predicted FROM (
    SELECT label AS c, CASE WHEN label = prediction THEN 1 ELSE 0 END AS tp, 1 AS actual,
           0 AS guessed FROM {source}
    UNION ALL SELECT prediction, 0, 0, 1 FROM {source}) GROUP BY c)"""


def _ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0 ELSE CAST({top} AS DOUBLE) / {bottom} END"


def _language(test: str, key: str, fitted: str = "documents") -> str:
    """CTEs of the language model fitted on ``fitted``, ending in ``spoken``."""
    grams = """SELECT {columns}, substring(' ' || w || ' ', CAST(i AS BIGINT), 3) AS gram
  FROM (SELECT {columns}, w, unnest(range(1, length(w) + 1)) AS i FROM {rows})"""
    words = "unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w"
    fit = grams.format(columns="lang", rows=f"(SELECT lang, {words} FROM {fitted})")
    use = grams.format(columns=key, rows=f"(SELECT {key}, {words} FROM {test})")
    return f"""
lang_docs AS (SELECT lang, count(*) AS docs, sum(count(*)) OVER () AS total FROM {fitted} GROUP BY lang),
lang_grams AS (SELECT lang, gram, count(*) AS c FROM ({fit}) GROUP BY 1, 2),
lang_sizes AS (
  SELECT lang, sum(c) AS size, (SELECT count(DISTINCT gram) FROM lang_grams) AS v
  FROM lang_grams GROUP BY lang),
lang_use AS (SELECT {key}, gram, count(*) AS uses FROM ({use}) GROUP BY 1, 2),
lang_known AS (
  SELECT u.* FROM lang_use u WHERE gram IN (SELECT gram FROM lang_grams)),
lang_sums AS (
  SELECT u.{key}, z.lang, sum(u.uses * ln((coalesce(g.c, 0) + 1.0) / (z.size + z.v))) AS s
  FROM lang_known u CROSS JOIN lang_sizes z
  LEFT JOIN lang_grams g ON g.gram = u.gram AND g.lang = z.lang GROUP BY 1, 2),
lang_ranked AS (
  SELECT x.{key}, d.lang, row_number() OVER (
    PARTITION BY x.{key} ORDER BY round(ln(CAST(d.docs AS DOUBLE) / d.total) + coalesce(s.s, 0), 6) DESC,
      d.lang) AS place
  FROM {test} x CROSS JOIN lang_docs d
  LEFT JOIN lang_sums s ON s.{key} = x.{key} AND s.lang = d.lang),
spoken AS (SELECT {key}, lang FROM lang_ranked WHERE place = 1)"""


def _weights(name: str, plus: str, minus: str) -> str:
    return f"""
{name} AS (
  SELECT token, CAST({plus} - {minus} AS DOUBLE) / ({plus} + {minus}) AS weight
  FROM best_counts WHERE {plus} + {minus} > 0)"""


_LEXICON = _weights("word_weights", "n_pos", "n_neg")
_SECOND_LEXICON = _weights("other_weights", "n_neutral", "n_pos")


def _lexicon_sums(test: str, name: str = "lexicon_sums", weights: str = "word_weights") -> str:
    return f"""
{name} AS (
  SELECT x.doc_id, coalesce(sum(w.weight), 0) AS total, count(w.weight) AS found
  FROM {test} x LEFT JOIN (SELECT doc_id, lower(unnest({_TOKENS})) AS token FROM {test}) t
    ON t.doc_id = x.doc_id LEFT JOIN {weights} w ON w.token = t.token GROUP BY x.doc_id)"""


def _sign(score: str, pos: str = "pos", neg: str = "neg") -> str:
    return f"CASE WHEN {score} > 0 THEN '{pos}' WHEN {score} < 0 THEN '{neg}' ELSE 'neutral' END"


_CODE = """CASE WHEN toxic = 1 AND quality = 1 THEN 3 WHEN toxic = 1 THEN 0
  WHEN quality = 1 THEN 4 ELSE 2 END"""
_BATCH = """
batch AS (
  SELECT l_orderkey AS o_orderkey, l_linestatus AS o_orderstatus, l_extendedprice AS o_totalprice,
         l_shipdate AS o_orderdate, l_linenumber, l_partkey FROM lineitem),
target AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'),
latest AS (
  SELECT * FROM batch QUALIFY row_number() OVER (
    PARTITION BY o_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, o_totalprice DESC,
    o_orderdate DESC) = 1)"""
_UPSERTED = f"""WITH {_BATCH}
SELECT coalesce(t.o_orderkey, b.o_orderkey) AS o_orderkey, t.o_custkey,
       CASE WHEN b.o_orderkey IS NULL THEN t.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
       CASE WHEN b.o_orderkey IS NULL THEN t.o_totalprice ELSE b.o_totalprice END AS o_totalprice,
       CASE WHEN t.o_orderkey IS NULL THEN b.o_orderdate ELSE t.o_orderdate END AS o_orderdate,
       t.o_orderpriority
FROM target t FULL JOIN latest b ON t.o_orderkey = b.o_orderkey"""

_EVENT_COUNT = "CAST(json_extract(props, '$.k') AS INTEGER)"
_LANDED = f"""
first_landing AS (
  SELECT event_id, event_type AS kind, user_id, value, {_EVENT_COUNT} AS k FROM events
  WHERE event_type <> 'signup'),
refs AS (
  SELECT b.event_id, b.event_type AS kind, b.user_id, b.value, {_EVENT_COUNT.replace("props", "b.props")} AS k
  FROM events p JOIN events b ON b.event_id = p.event_id - 1
  WHERE p.event_type = 'purchase' AND b.event_id NOT IN (SELECT event_id FROM first_landing)),
second_landing AS (
  SELECT event_id, event_type AS kind, user_id, value, {_EVENT_COUNT} + 1000 AS k FROM events
  WHERE event_type IN ('click', 'signup')),
stored_first AS (SELECT * FROM first_landing UNION ALL SELECT * FROM refs)"""

_SHOWN = "CASE WHEN {k} = 'view' THEN 'long view' ELSE {k} END"


def _bayes_and_language(test: str) -> str:
    others = _lexicon_sums(test, "other_sums", "other_weights")
    return (
        f"{_presence('labelled', test)},{_LEXICON},{_lexicon_sums(test)},{_SECOND_LEXICON},{others}"
    )


_SENTIMENTS = f"""WITH {_LABELLED},{_language("documents", "doc_id")},
chosen AS (
  SELECT d.doc_id, d.text FROM documents d JOIN spoken s ON s.doc_id = d.doc_id
  WHERE s.lang = 'en' AND {_TOPIC.replace("text", "d.text")}),{_bayes_and_language("chosen")},
found_labels AS (
  SELECT p.doc_id, p.prediction, round(l.total / greatest(l.found, 1), 6) AS mean,
         round(o.total / sqrt(o.total * o.total + 15.0), 6) AS compound
  FROM predicted p JOIN lexicon_sums l ON l.doc_id = p.doc_id
  JOIN other_sums o ON o.doc_id = p.doc_id)
SELECT d.doc_id, d.text, coalesce(f.prediction, 'none') AS sentiment_naivebayes,
       CASE WHEN f.doc_id IS NULL THEN 'none' ELSE {_sign("f.mean")} END AS sentiment_textblob,
       CASE WHEN f.doc_id IS NULL THEN 'none' ELSE {_sign("f.compound")} END AS sentiment_vader
FROM documents d LEFT JOIN found_labels f ON f.doc_id = d.doc_id"""


SQL: dict[str, str] = {
    "word_freq": f"""
SELECT token, count(*) AS n
FROM (SELECT lower(unnest({_TOKENS})) AS token FROM documents) GROUP BY token""",
    "word_freq_by_label": f"""WITH {_LABELLED},{_best_three("labelled")}
SELECT * FROM best_counts""",
    "label_totals": f"""WITH {_LABELLED},{_best_three("labelled")}
SELECT CAST(t AS BIGINT) AS n, CAST(t_pos AS BIGINT) AS n_pos,
       CAST(t_neutral AS BIGINT) AS n_neutral, CAST(t_neg AS BIGINT) AS n_neg FROM best_totals""",
    "chi2_words_2class": f"WITH {_LABELLED},{_BEST_TWO} SELECT * FROM best_two",
    "chi2_words_cut": f"""WITH {_LABELLED},{_BEST_TWO}
SELECT * FROM two_scores ORDER BY score DESC, token LIMIT {WORDS_CUT}""",
    "chi2_words_3class": f"WITH {_LABELLED},{_best_three('labelled')} SELECT * FROM best",
    "chi2_bigrams": f"WITH {_BEST_BIGRAMS} SELECT * FROM best_bigrams",
    "feature_union": f"""WITH {_LABELLED},{_BEST_TWO},{_BEST_BIGRAMS}
SELECT token AS feature FROM best_two
UNION ALL SELECT w1 || ' ' || w2 FROM best_bigrams""",
    "clean_spacing": f"""
SELECT doc_id, trim({_replace(
        "text", (f"({tx.HANDLE})|({tx.SYMBOL})|({tx.URL})", " "), (tx.BLANKS, " "))}) AS cleaned
FROM documents""",
    "clean_strict": f"""
SELECT doc_id, trim({_replace(
        "text", (tx.HANDLE, " "), (tx.URL, " "), ("[0-9]+", " "), ("&amp;", " "),
        ("&quote;", " "), (tx.SYMBOL, ""), (tx.BLANKS, " "))}) AS cleaned
FROM documents""",
    "squeeze_letters": """WITH letters AS (
  SELECT doc_id, regexp_extract_all(text, '(?s).') AS c,
         regexp_extract_all(lower(text), '(?s).') AS low FROM documents)
SELECT doc_id, coalesce(array_to_string(list_filter(c, lambda x, i:
    i < 3 OR low[i] <> low[i - 1] OR low[i] <> low[i - 2]), ''), '') AS cleaned
FROM letters""",
    "page_cleaning": f"""
SELECT page_id, trim({_replace(
        "url", (f"({tx.HANDLE})|({tx.SYMBOL})|({tx.URL})", " "), (tx.BLANKS, " "))}) AS spacing,
       trim({_replace(
        "url", (tx.HANDLE, " "), (tx.URL, " "), ("[0-9]+", " "), ("&amp;", " "),
        ("&quote;", " "), (tx.SYMBOL, ""), (tx.BLANKS, " "))}) AS strict,
       coalesce(array_to_string({_TOKENS.replace("text", "url")}, ' '), '') AS tokens
FROM pages""",
    "token_presence": f"""
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct({_TOKENS})), ' '), '') AS features
FROM documents""",
    "vocab_presence": f"""WITH {_LABELLED},{_best_three("labelled")},
kept AS (
  SELECT doc_id, string_agg(token, ' ' ORDER BY token) AS features FROM (
    SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM labelled)
    WHERE {_NO_HANDLE} AND token IN (SELECT token FROM best)) GROUP BY doc_id)
SELECT l.doc_id, CASE l.polarity WHEN 4 THEN 'pos' WHEN 2 THEN 'neutral' ELSE 'neg' END AS label,
       coalesce(k.features, '') AS features
FROM labelled l LEFT JOIN kept k ON k.doc_id = l.doc_id""",
    "stopword_removal": f"""WITH frequent AS (
  SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents)
  GROUP BY token ORDER BY n DESC, token LIMIT {STOPWORDS}),
stop AS (SELECT list(DISTINCT replace(token, '''', '')) AS words FROM frequent)
SELECT doc_id, coalesce(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'),
         lambda w: w <> '' AND NOT list_contains(words, w)), ' '), '') AS kept
FROM documents, stop""",
    "polarity_label": f"""
SELECT doc_id, CASE {_CODE} WHEN 4 THEN 'pos' WHEN 2 THEN 'neutral' WHEN 0 THEN 'neg' END AS label,
       CASE {_CODE} WHEN 4 THEN 'pos' WHEN 2 THEN 'neutral' ELSE 'neg' END AS counted_three,
       CASE {_CODE} WHEN 0 THEN '0' ELSE '4' END AS counted_two FROM labels""",
    "sign_label": f"""
SELECT c_custkey, {_sign("c_acctbal")} AS label,
       {_sign("c_acctbal", "positive", "negative")} AS long_label FROM customer""",
    "topic_filter": f"SELECT doc_id, n_chars FROM documents WHERE {_TOPIC}",
    "gated_label": f"""WITH {_LABELLED}
SELECT l.doc_id, CASE WHEN {_TOPIC.replace("text", "l.text")} AND d.lang = 'en'
  THEN CASE l.polarity WHEN 4 THEN 'pos' WHEN 2 THEN 'neutral' ELSE 'neg' END
  ELSE 'none' END AS label
FROM labelled l JOIN documents d ON d.doc_id = l.doc_id""",
    "split_nested": f"""
SELECT event_id AS tweet_id, {_SHOWN.format(k="event_type")} AS tweet_text, user_id,
       date_trunc('second', ts) AS created_at, 'web' AS source, false AS retweeted,
       {_EVENT_COUNT} AS retweet_count, value > 50 AS favorited,
       CAST(floor(value) AS INTEGER) AS favorite_count FROM events""",
    "split_nested_users": """
SELECT user_id AS twitter_user_id, 'user ' || user_id AS name, 'seen at ' || event_id AS screen_name,
       CAST(event_id AS INTEGER) AS statuses_count FROM events""",
    "missing_refs": """WITH turns AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS turn_key, role, text FROM conversations),
collected AS (SELECT * FROM turns WHERE role = 'assistant')
SELECT turn_key, role, text, false AS added FROM collected
UNION ALL
SELECT t.turn_key, t.role, t.text, true FROM turns t
WHERE EXISTS (SELECT 1 FROM collected c WHERE c.conv_id = t.conv_id AND c.turn = t.turn + 1)
  AND t.turn_key NOT IN (SELECT turn_key FROM collected)""",
    "first_per_user": """
SELECT user_id, ts, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
    "new_users": """
SELECT o_custkey, o_orderdate, o_orderkey FROM orders
WHERE o_custkey NOT IN (SELECT user_id FROM events)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
    "new_rows": """
SELECT s.* FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') t
RIGHT JOIN orders s ON t.o_orderkey = s.o_orderkey WHERE t.o_orderkey IS NULL""",
    "insert_ignore": f"""WITH {_BATCH}
SELECT * FROM batch WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target)
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, o_totalprice, o_orderdate) = 1""",
    "upsert_partial": _UPSERTED,
    "upsert_partial_shuffled": _UPSERTED,
    "upsert_full": """WITH placed AS (
  SELECT user_id || ':' || strftime(ts, '%H%M') AS place, event_id, event_type, value FROM events),
batch AS (
  SELECT * FROM placed WHERE event_type IN ('purchase', 'error')
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY event_id DESC) = 1),
target AS (
  SELECT * FROM placed WHERE event_type NOT IN ('purchase', 'error')
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY event_id) = 1)
SELECT * FROM batch
UNION ALL SELECT * FROM target WHERE place NOT IN (SELECT place FROM batch)""",
    "duplicate_keys": """
SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1""",
    "orphan_rows": """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)""",
    "orphan_keys": """
SELECT o_custkey, count(*) AS n FROM orders
WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY o_custkey""",
    "surrogate_ids": """
SELECT c_custkey, c_mktsegment,
       row_number() OVER (ORDER BY c_mktsegment <> 'BUILDING', c_custkey) AS id FROM customer""",
    "latest_id": "SELECT event_id AS latest_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1",
    "ids_since": """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > (
  SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)""",
    "stratified_split": f"""WITH {_LABELLED},{_split("labelled", "polarity IN (0, 4)")}
SELECT doc_id, polarity, part FROM parts""",
    "split_counts": f"""WITH {_LABELLED},{_split("labelled", "polarity IN (0, 4)")}
SELECT polarity, part, count(*) AS n FROM parts GROUP BY polarity, part""",
    "write_counts": f"""WITH {_LABELLED},{_split("labelled", "polarity IN (0, 4)")}
SELECT part, count(*) AS n FROM parts GROUP BY part
UNION ALL SELECT 'rows', count(*) FROM parts""",
    "presence_nb_predict": f"""WITH {_LABELLED},{_presence("labelled", "documents")}
SELECT doc_id, prediction FROM predicted""",
    "nb_informative": f"""WITH {_LABELLED},{_presence("labelled", "labelled")},
chances AS (
  SELECT token, true AS present, label, (c + 0.5) / (size + half_bins) AS p FROM model WHERE c > 0
  UNION ALL
  SELECT token, false, label, (size - c + 0.5) / (size + half_bins) FROM model WHERE c < size)
SELECT token, present, arg_max(label, (p, label)) AS high_label, arg_min(label, (p, label)) AS low_label,
       round(max(p) / min(p), 6) AS ratio
FROM chances GROUP BY token, present ORDER BY ratio DESC, token, present DESC LIMIT 10""",
    "multinomial_nb_predict": f"""WITH {_LABELLED},
train AS (SELECT * FROM labelled WHERE polarity <> 2),
classes AS (SELECT polarity, count(*) AS docs, sum(count(*)) OVER () AS total FROM train GROUP BY 1),
fit AS (
  SELECT polarity, token, count(*) AS c
  FROM (SELECT polarity, unnest({_WORDS}) AS token FROM train) GROUP BY 1, 2),
sizes AS (
  SELECT polarity, sum(c) AS size, (SELECT count(DISTINCT token) FROM fit) AS v FROM fit GROUP BY 1),
uses AS (
  SELECT doc_id, token, count(*) AS uses
  FROM (SELECT doc_id, unnest({_WORDS}) AS token FROM documents) GROUP BY 1, 2),
sums AS (
  SELECT u.doc_id, z.polarity, sum(u.uses * ln((coalesce(f.c, 0) + 1.0) / (z.size + z.v))) AS s
  FROM uses u CROSS JOIN sizes z LEFT JOIN fit f ON f.token = u.token AND f.polarity = z.polarity
  WHERE u.token IN (SELECT token FROM fit) GROUP BY 1, 2)
SELECT d.doc_id, CASE k.polarity WHEN 4 THEN 'pos' ELSE 'neg' END AS prediction
FROM documents d CROSS JOIN classes k
LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.polarity = k.polarity
QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY
  round(ln(CAST(k.docs AS DOUBLE) / k.total) + coalesce(s.s, 0), 6) DESC, k.polarity) = 1""",
    "confusion": f"""WITH {_HELD_OUT}
SELECT label, prediction, count(*) AS n FROM outcome GROUP BY label, prediction""",
    "accuracy": f"""WITH {_HELD_OUT}
SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM outcome""",
    "class_prf": f"""WITH {_HELD_OUT},{_sides("outcome")},
pr AS (
  SELECT label, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted END AS precision,
         CASE WHEN actual > 0 THEN CAST(tp AS DOUBLE) / actual END AS recall FROM sides)
SELECT label, precision, recall,
       CASE WHEN precision IS NULL OR recall IS NULL THEN NULL
            WHEN precision = 0 OR recall = 0 THEN 0.0
            ELSE 1.0 / (0.5 / precision + 0.5 / recall) END AS f_measure FROM pr""",
    "class_report": f"""WITH {_HELD_OUT},
clear AS (SELECT * FROM outcome WHERE label <> 'neutral'),{_sides("clear")},
rows_ AS (
  SELECT label, {_ratio("tp", "predicted")} AS precision, {_ratio("tp", "actual")} AS recall,
         {_ratio("2 * tp", "(predicted + actual)")} AS f1, CAST(actual AS BIGINT) AS support
  FROM sides)
SELECT label AS row, precision, recall, f1, support FROM rows_
UNION ALL SELECT 'micro avg', {_ratio("sum(tp)", "sum(predicted)")}, {_ratio("sum(tp)", "sum(actual)")},
  {_ratio("2 * sum(tp)", "(sum(predicted) + sum(actual))")}, CAST(sum(actual) AS BIGINT) FROM sides
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM rows_
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
  sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
  CAST(sum(support) AS BIGINT) FROM rows_""",
    "idf": f"""WITH lists AS (SELECT doc_id, {_WORDS} AS t FROM documents),
terms AS (
  SELECT doc_id, unnest(t) AS term FROM lists UNION
  SELECT doc_id, p[1] || ' ' || p[2] FROM (
    SELECT doc_id, unnest(list_zip(t[1:len(t) - 1], t[2:len(t)])) AS p FROM lists WHERE len(t) > 1))
SELECT term, count(*) AS df,
       ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf
FROM terms GROUP BY term""",
    "tfidf": f"""WITH lists AS (SELECT doc_id, {_WORDS} AS t FROM documents),
terms AS (
  SELECT doc_id, unnest(t) AS term FROM lists UNION ALL
  SELECT doc_id, p[1] || ' ' || p[2] FROM (
    SELECT doc_id, unnest(list_zip(t[1:len(t) - 1], t[2:len(t)])) AS p FROM lists WHERE len(t) > 1)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
idf AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf
  FROM tf GROUP BY term),
raw AS (SELECT doc_id, tf.term, tf, tf * idf AS w FROM tf JOIN idf ON tf.term = idf.term),
lengths AS (SELECT doc_id, sqrt(sum(w * w)) AS length FROM raw GROUP BY doc_id)
SELECT r.doc_id, term, CAST(tf AS INTEGER) AS tf, round(w / length, 6) AS weight
FROM raw r JOIN lengths l ON r.doc_id = l.doc_id""",
    "lang_predict": f"""WITH turns AS (
  SELECT conv_id || ':' || turn AS turn_key, text FROM conversations),{_language("turns", "turn_key")}
SELECT turn_key, lang FROM spoken""",
    "lang_filter": f"""WITH seen AS (
  SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
others AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),{
        _language("others", "doc_id", "seen")}
SELECT d.doc_id, d.n_chars FROM documents d JOIN spoken s ON s.doc_id = d.doc_id
WHERE s.lang = 'en'""",
    "lexicon_label": f"""WITH {_LABELLED},{_best_three("labelled")},{_LEXICON},{_lexicon_sums("documents")},
scored AS (SELECT doc_id, round(total / greatest(found, 1), 6) AS score FROM lexicon_sums)
SELECT doc_id, score, {_sign("score")} AS label FROM scored""",
    "cleaned_sentiment": f"""WITH {_LABELLED},{_best_three("labelled")},{_LEXICON},
cleaned AS (SELECT doc_id, trim({_replace(
        "text", (f"({tx.HANDLE})|({tx.SYMBOL})|({tx.URL})", " "), (tx.BLANKS, " "))}) AS text
  FROM documents),{_lexicon_sums("cleaned")},
scored AS (SELECT doc_id, round(total / greatest(found, 1), 6) AS score FROM lexicon_sums)
SELECT doc_id, score, {_sign("score", "positive", "negative")} AS label FROM scored""",
    "sentiment_columns": _SENTIMENTS,
    "sentiments_stored": f"""SELECT doc_id AS tweet_id, text AS tweet_text, sentiment_naivebayes,
  sentiment_textblob,
  CASE WHEN length(text) < 1000 THEN 'first' ELSE sentiment_vader END AS sentiment_vader
FROM ({_SENTIMENTS})""",
    # The solver's optimum can't be found by SQL, but its gradient is 0.
    "logreg_optimum": f"""WITH {_LABELLED},{_split("labelled", "polarity IN (0, 4)")},
cleaned AS (SELECT doc_id, trim({_replace(
        "text", (tx.HANDLE, " "), (tx.URL, " "), ("[0-9]+", " "), ("&amp;", " "),
        ("&quote;", " "), (tx.SYMBOL, ""), (tx.BLANKS, " "))}) AS text
  FROM parts WHERE part = 'train'),
lists AS (SELECT {_WORDS} AS t FROM cleaned),
terms AS (
  SELECT unnest(t) AS term FROM lists UNION
  SELECT p[1] || ' ' || p[2] FROM (
    SELECT unnest(list_zip(t[1:len(t) - 1], t[2:len(t)])) AS p FROM lists WHERE len(t) > 1))
SELECT (SELECT count(*) FROM cleaned) AS rows, count(*) AS terms, 1.0 AS strength, 0.0 AS gradient
FROM terms""",
    "json_round_trip": "SELECT conv_id, turn, role, text FROM conversations",
    "csv_round_trip": f"""WITH {_LABELLED}
SELECT CAST(polarity AS INTEGER) AS polarity, doc_id AS tweet_id, '-' AS date, 'NO_QUERY' AS query,
       'user ' || doc_id AS "user", text
FROM labelled""",
    "csv_export": "SELECT conv_id, turn, text FROM conversations",
    "stream_upsert": f"""WITH {_LANDED}
SELECT coalesce(a.event_id, b.event_id) AS tweet_id,
       CASE WHEN a.event_id IS NULL THEN
         'late ' || b.kind ELSE {_SHOWN.format(k="a.kind")} END AS tweet_text,
       coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.k, a.k) AS retweet_count,
       CAST(floor(coalesce(b.value, a.value)) AS INTEGER) AS favorite_count
FROM stored_first a FULL JOIN second_landing b ON a.event_id = b.event_id""",
    "collect_batch": f"""WITH early AS (
  SELECT * FROM events WHERE event_id <= 4000 AND event_type <> 'error'),
mark AS (SELECT event_id FROM early ORDER BY date_trunc('second', ts) DESC, event_id DESC LIMIT 1)
SELECT event_id AS tweet_id, {_SHOWN.format(k="event_type")} AS tweet_text, user_id,
       {_EVENT_COUNT} AS retweet_count
FROM events WHERE (event_id <= 4000 AND event_type <> 'error')
  OR event_id > (SELECT event_id FROM mark)""",
    # The newest landings are those of the last two kinds.
    "capped_intake": """
SELECT event_id AS tweet_id FROM events WHERE event_type IN ('signup', 'error')""",
    "first_users_stream": """
SELECT user_id AS twitter_user_id, 'user ' || user_id AS name,
       CASE WHEN bool_or(coalesce(value, 0) >= 99) THEN 'first' ELSE 'second' END AS location
FROM events GROUP BY user_id""",
    "sentiments_checked": """WITH batch AS (
  SELECT doc_id AS tweet_id, text AS tweet_text, 0 AS place FROM documents
  UNION ALL SELECT doc_id, '~ again', 1 FROM labels),
runs AS (
  SELECT *, 1 AS run FROM batch WHERE length(tweet_text) < 1000
  UNION ALL SELECT *, 2 FROM batch),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run, tweet_id ORDER BY tweet_text) AS r FROM runs),
parents AS (SELECT doc_id FROM labels),
written AS (SELECT tweet_id, run FROM ranked WHERE r = 1 AND tweet_id IN (SELECT doc_id FROM parents)),
first_run AS (SELECT tweet_id FROM written WHERE run = 1)
SELECT tweet_id, tweet_text,
       CASE WHEN r > 1 THEN 'repeated key'
            WHEN run = 2 AND tweet_id IN (SELECT tweet_id FROM first_run) THEN 'stored key'
            WHEN tweet_id NOT IN (SELECT doc_id FROM parents) THEN 'no parent'
            ELSE 'written' END AS outcome
FROM ranked""",
    "stored_ids": "SELECT event_id AS tweet_id FROM events",
    "stream_users_once": f"""WITH {_LANDED},
named AS (
  SELECT user_id, max(event_id) AS seen, 1 AS rank FROM first_landing GROUP BY 1
  UNION ALL SELECT user_id, max(event_id), 2 FROM refs GROUP BY 1
  UNION ALL SELECT user_id, max(event_id), 3 FROM second_landing GROUP BY 1)
SELECT user_id AS twitter_user_id, 'user ' || user_id AS name, 'seen at ' || seen AS screen_name,
       CAST(seen AS INTEGER) AS statuses_count
FROM named QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank) = 1""",
}
