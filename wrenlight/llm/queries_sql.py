"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
       sha256(body) AS text_sha256
FROM t JOIN g USING (body)
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15])::BIGINT AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *,
         150 * sum(source_size) OVER ()
           - 200 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s
), v AS (
  SELECT max(CASE WHEN NOT 200 * source_size * weights <= weight * rest
             THEN CAST(rest AS DOUBLE) / CAST(weights AS DOUBLE) / 100.0 END) AS level FROM l
), t AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL THEN 2.0 * source_size::DOUBLE
              ELSE least(2.0 * source_size::DOUBLE, weight * level) END::DOUBLE AS target
  FROM l, v
), h AS (
  SELECT source, hash, sum(size) AS size,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY hash
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d GROUP BY source, hash
), k AS (
  SELECT h.source, h.hash, t.source_size, t.target,
         CASE WHEN t.target > t.source_size
              THEN 1 + (h.size <= 2 * (t.target - t.source_size - h.before))::INT
              ELSE (h.size <= 2 * (t.target - h.before))::INT END AS copies
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source
)
SELECT d.doc_id, d.size::BIGINT AS size, k.source_size, k.target, (k.copies * d.size)::BIGINT AS taken
FROM d JOIN k ON d.hash = k.hash AND d.source IS NOT DISTINCT FROM k.source
"""


def _spans(kind: str, place: int, pattern: str, keep: str) -> str:
    """Rows ``doc_id, start, place, kind, stop`` of one pattern's leftmost matches."""
    return f"""
  SELECT doc_id, start, {place} AS place, '{kind}' AS kind, start + length(hit) AS stop FROM (
    SELECT doc_id, hits[i] AS hit,
           list_sum(list_transform(parts[1:i], lambda p: length(p)))
             + coalesce(list_sum(list_transform(hits[1:i - 1], lambda p: length(p))), 0) AS start
    FROM (
      SELECT doc_id, regexp_extract_all(body, '{pattern}') AS hits,
             regexp_split_to_array(body, '{pattern}') AS parts
      FROM t WHERE regexp_matches(body, '{pattern}')
    ), range(1, len(hits) + 1) r(i)
  ) WHERE {keep}"""


_ASSIGN = (
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[""''"]?\x20*[:=]\x20*[""''"]?[A-Za-z0-9+/_.=-]+"""
)
_VALUE = r"""length(regexp_extract(hit, '^[a-zA-Z_]+[""''"]?\x20*[:=]\x20*[""''"]?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"""

SECRETS = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), f AS ("
    + "\n  UNION ALL".join(
        [
            _spans("assign", 0, _ASSIGN, _VALUE),
            _spans("access", 1, "AKIA[A-Z0-9]+", "length(hit) >= 20"),
            _spans("hex", 2, "[0-9a-f]+", "length(hit) >= 24"),
            _spans("private_key", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
            _spans(
                "web_token",
                4,
                r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
                "true",
            ),
        ]
    )
    + r"""
), g AS (
  SELECT doc_id,
         count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
         count(*) FILTER (place = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)
           FILTER (place < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM (SELECT doc_id, start::BIGINT AS start, place, kind, stop::BIGINT AS stop FROM f) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""
)

#: The 256 entries of the CRC-32 table, made by its polynomial.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) t(i)
)"""


def _crc(data: str) -> str:
    """CRC-32 of a list of bytes, by ``crc_table``."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {data}),
    lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)))"""


# Runs by pairs of equal six-word shingles: of a run, at least six words in a row come again
# one period later.
PERIODIC_RUNS = (
    "WITH "
    + _CRC_TABLE
    + ", d AS (SELECT row_number() OVER () AS row, doc_id, text,"
    + _crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)")
    + r""" AS h FROM documents, crc_table
), s AS (
  SELECT row, doc_id, h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM d
), l AS (
  SELECT *, (h // 10) % len(w) AS a,
         1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p
  FROM s
), w AS (
  SELECT row, doc_id,
         CASE WHEN h % 10 = 0 AND len(w) > 0
              THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
              ELSE w END AS w
  FROM l
), g AS (
  SELECT row, i, array_to_string(w[i + 1:i + 6], ' ') AS gram
  FROM w, range(len(w) - 5) r(i)
), e AS (
  SELECT x.row, x.i, y.i - x.i AS p FROM g x JOIN g y ON x.row = y.row AND x.gram = y.gram AND x.i < y.i
), m AS (
  SELECT row, p, min(i) AS start, count(*) + 5 + p AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, p ORDER BY i) AS island FROM e)
  GROUP BY row, p, island
), r AS (
  SELECT row, start, length::BIGINT AS length, min(p) AS period
  FROM m WHERE length >= greatest(12, 2 * p) GROUP BY row, start, length
), b AS (
  SELECT row, count(*) AS n_runs,
         first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM r GROUP BY row
), k AS (
  SELECT DISTINCT row, i FROM r, range(start + period, start + length) t(i)
), c AS (
  SELECT x.row, string_agg(x.word, ' ' ORDER BY x.i) AS text
  FROM (SELECT row, i, w[i + 1] AS word FROM w, range(len(w)) t(i)) x ANTI JOIN k USING (row, i)
  GROUP BY x.row
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length,
       best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM w LEFT JOIN b USING (row) LEFT JOIN c USING (row)
"""
)

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), g AS (
  SELECT row, i, sha256(array_to_string(w[i + 1:i + 35], ' ')) AS gram
  FROM d, range(len(w) - 34) r(i)
), k AS (
  SELECT DISTINCT row, i + j AS i
  FROM (SELECT *, count(*) OVER (PARTITION BY gram) AS n FROM g), range(35) t(j) WHERE n > 1
), c AS (
  SELECT x.row, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.i) AS text
  FROM (SELECT row, i, w[i + 1] AS word FROM d, range(len(w)) t(i)) x ANTI JOIN k USING (row, i)
  GROUP BY x.row
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN c USING (row)
"""

# Near words by what is left when one letter goes: an inserted or deleted letter leaves the
# other word, a replaced one leaves the same at the same place.
SPELLING_VARIANTS = (
    "WITH "
    + _CRC_TABLE
    + r"""
, t AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[a-z\x{00C0}-\x{00FF}]+') AS runs
  FROM documents
), u AS (
  SELECT id, run, count(*) AS n FROM (SELECT id, unnest(runs) AS run FROM t)
  WHERE length(run) >= 6 GROUP BY id, run
), x AS (
  SELECT *, hex(encode(id || ':' || run)) AS code FROM u
), h AS (
  SELECT run, n, """
    + _crc("list_transform(range(1, len(code), 2), lambda i: ('0x' || code[i:i + 1])::BIGINT)")
    + r""" AS h, id FROM x, crc_table
), e AS (
  SELECT n, CASE WHEN id IS NOT NULL AND h % 199 = 0
                 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
  FROM h
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), l AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM v, range(1, length(word) + 1) r(i)
), p AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM l a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM l a JOIN v b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM l a JOIN l b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
), m AS (
  SELECT word, count(*) AS n_near,
         first(struct_pack(other, other_n) ORDER BY other_n DESC, other) AS best
  FROM p GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN best.other_n >= 5 * v.n THEN best.other END AS form,
         CASE WHEN best.other_n >= 5 * v.n THEN best.other_n END AS form_n
  FROM v LEFT JOIN m USING (word)
), c AS (
  WITH RECURSIVE s AS (
    SELECT word, form AS root, 1 AS depth FROM f WHERE form IS NOT NULL
    UNION ALL SELECT s.word, f.form, depth + 1 FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL
  ) SELECT word, arg_max(root, depth) AS root FROM s GROUP BY word
)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n
FROM f LEFT JOIN c USING (word)
"""
)

SQL = {
    "op3_exact_dedup": EXACT_DEDUP,
    "op6_mixing": MIXING,
    "op7_secrets": SECRETS,
    "op11_periodic_runs": PERIODIC_RUNS,
    "op12_substring_dedup": SUBSTRING_DEDUP,
    "op13_spelling_variants": SPELLING_VARIANTS,
}
