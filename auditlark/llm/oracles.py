"""DuckDB twins of the queries that SQL can express, written from the contracts rather than from the operators."""

from __future__ import annotations

from . import licenses, secrets


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOPK = """
WITH raw AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0)
, scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM raw q JOIN raw c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
QUALIFY rank <= 5"""

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
, b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
, windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS text
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0))
, places AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS text
  FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k))
, found AS (SELECT rid, item_id, p, k FROM places JOIN windows USING (k, text))
, hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS pos FROM found) GROUP BY 1)
, ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)"""


def _matches(name: str, pattern: str, group: int = 0) -> str:
    """CTE of (rid, start, stop, value): positions from the pieces between matches."""
    return rf"""
, {name}_lists AS (SELECT rid, regexp_extract_all(text, {_text(pattern)}, 0) AS m, regexp_extract_all(text, {_text(pattern)}, {group}) AS g,
    string_split_regex(text, {_text(pattern)}) AS pieces FROM d WHERE regexp_matches(text, {_text(pattern)}))
, {name}_rows AS (SELECT rid, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS whole, unnest(g) AS value, unnest(pieces[1:len(m)]) AS piece FROM {name}_lists)
, {name} AS (SELECT rid, value, whole, stop - length(whole) AS start, stop
  FROM (SELECT *, sum(length(piece) + length(whole)) OVER (PARTITION BY rid ORDER BY i) AS stop FROM {name}_rows))"""


def secrets_sql() -> str:
    allowed = " AND ".join(f"NOT regexp_matches(value, {_text(p)})" for p in secrets.ALLOW)
    # RE2 has no back references: a run of each character is an alternative of its own.
    runs = "|".join(f"\\x{ord(c):02x}{{8,}}" for c in secrets.BASE64_ALPHABET + "_-")
    words = _text(secrets.ALLOW_WORDS.replace(r"(.)\1{7,}", runs))
    window = secrets.WINDOW
    kinds = ", ".join(f"({i}, {_text(k)})" for i, k in enumerate(secrets.KINDS))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)
{_matches('assigned', secrets.ASSIGN, 2)}{_matches('access', secrets.ACCESS)}{_matches('hexes', secrets.HEX.replace('+', '{32,}'))}{_matches('candidate', secrets.CANDIDATE)}
, base AS (SELECT rid, start, 0 AS rank, stop FROM assigned WHERE length(value) >= 8
  UNION ALL SELECT rid, start, 1, stop FROM access WHERE length(value) >= 16 UNION ALL SELECT rid, start, 2, stop FROM hexes)
, open_ AS (SELECT rid, start, regexp_full_match(value, '[0-9a-fA-F]+') AS is_hex, string_split_regex(value, {words}) AS parts,
    list_append(regexp_extract_all(value, {words}), '') AS gaps FROM candidate WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND {allowed})
, parts AS (SELECT rid, start, is_hex, unnest(range(len(parts))) AS i, unnest(parts) AS value, unnest(gaps) AS gap FROM open_)
, pieces AS (SELECT rid, start + sum(length(value) + length(gap)) OVER (PARTITION BY rid, start ORDER BY i) - length(value) - length(gap) AS start, is_hex, value FROM parts)
, windows AS (SELECT rid, start, is_hex, pos, string_split(substr(CASE WHEN is_hex THEN lower(value) ELSE translate(value, '-', '_') END, pos + 1, {window}), '') AS chars
  FROM (SELECT *, unnest(range(0, length(value) - {window - 1})) AS pos FROM pieces))
, high AS (SELECT rid, start, is_hex, pos FROM windows
  WHERE -list_sum(list_transform(list_distinct(chars), lambda c: len(list_filter(chars, lambda x: x = c)) / {window}.0::DOUBLE
    * log2(len(list_filter(chars, lambda x: x = c)) / {window}.0::DOUBLE))) > CASE WHEN is_hex THEN {secrets.HEX_BITS} ELSE {secrets.BASE64_BITS} END + 1e-9)
, marked AS (SELECT *, pos - coalesce(lag(pos) OVER w, -1000000) > {window} AS fresh FROM high WINDOW w AS (PARTITION BY rid, start ORDER BY pos))
, islands AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY rid, start ORDER BY pos) AS island FROM marked)
, entropy AS (SELECT rid, (start + min(pos))::BIGINT AS start, CASE WHEN is_hex THEN 3 ELSE 4 END AS rank, (start + max(pos) + {window})::BIGINT AS stop
  FROM islands GROUP BY rid, start, is_hex, island)
, spans AS (SELECT * FROM base UNION ALL SELECT e.* FROM entropy e
  WHERE NOT EXISTS (FROM base b WHERE b.rid = e.rid AND b.start <= e.start AND b.stop >= e.stop))
, named AS (SELECT rid, rank, start, stop, kind || ':' || start || ':' || stop AS span FROM spans JOIN (VALUES {kinds}) AS k(rank, kind) USING (rank))
, per_doc AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank, stop) AS spans FROM named GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_doc USING (rid)"""


def licenses_sql() -> str:
    listed = lambda words: f"[{', '.join(map(_text, words))}]::VARCHAR[]"
    known = ", ".join(
        f"({_text(name)}, {listed(licenses.template_bigrams(t))}, {listed(licenses.template_marks(t))}, "
        f"{listed([w for w in licenses.FAMILY if w not in licenses.template_words(t) and w not in ('by', 'library')])})"
        for name, t in licenses.TEMPLATES
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[!?:;]+(["''\)\]]*)([ \t\r\n]|\z)', '.\1\2', 'g'),
    '[^\p{{L}}\p{{N}}.+\n-]+', ' ', 'g') AS norm FROM documents)
, paragraphs AS (SELECT rid, norm, string_split_regex(norm, '\n[ ]*\n\s*') AS para FROM d)
, cut AS (SELECT rid, unnest(list_distinct(list_concat(list_concat(list_concat(string_split_regex(norm, '\.+[ \n]+|\n'), string_split_regex(norm, '\n')),
    flatten(list_transform(para, lambda p: string_split_regex(replace(p, chr(10), ' '), '\.+[ ]+')))), list_append(para, norm)))) AS unit FROM paragraphs)
, worded AS (SELECT rid, list_filter(string_split_regex(regexp_replace(unit, '\.+$', ''), '\.*[ \n]+'), lambda w: w <> '') AS w FROM cut)
, sets AS (SELECT DISTINCT rid, w, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS own FROM worded WHERE len(w) > 1)
, known AS (FROM (VALUES {known}) AS t(license, bigrams, marks, others))
, scored AS (SELECT rid, w, own, license, 2.0::DOUBLE * len(list_intersect(own, bigrams)) / (len(own) + len(bigrams)) AS dice FROM sets, known
  WHERE list_has_all(w, marks) AND NOT list_has_any(w, others))
, best AS (SELECT DISTINCT rid, own, license, dice FROM (SELECT * FROM scored WHERE dice >= {licenses.THRESHOLD} - 1e-12
  QUALIFY row_number() OVER (PARTITION BY rid, w ORDER BY dice DESC, license) = 1))
, per_doc AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names, max(dice) AS dice FROM best GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_units, coalesce(names, '') AS licenses, round(coalesce(dice, 0.0::DOUBLE), 6) AS best_dice
FROM d LEFT JOIN per_doc USING (rid)"""


VARIANTS = rf"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))
, runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
, counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL)
, bytes AS (SELECT id, run, n, hex(encode(id || ':' || run)) AS hx FROM counted)
, hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hx), 2), lambda p: ('0x' || substr(hx, p + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table)
, vocab AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
    ELSE run END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3)
, dels AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS less FROM (SELECT *, unnest(range(0, length(word))) AS p FROM vocab))
, near AS (SELECT a.word, b.word AS other, b.n AS m FROM dels a JOIN dels b USING (p, less) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM dels a JOIN vocab b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM dels a JOIN vocab b ON a.less = b.word)
, best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, encode(other))) AS other FROM near GROUP BY 1)
, formed AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END::BIGINT AS form_n
  FROM vocab v LEFT JOIN best USING (word))
, walk(word, reached) AS (SELECT word, word FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.reached AS root FROM formed f JOIN walk w USING (word) JOIN formed e ON e.word = w.reached WHERE e.form IS NULL"""


ORACLES = {
    "op3_topk": TOPK,
    "op5_licenses": licenses_sql(),
    "op8_secrets": secrets_sql(),
    "op9_decontamination": DECONTAMINATION,
    "op12_spellings": VARIANTS,
}
