"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .collocations import op11_phrase_collocations
from .decontaminate import op1_decontaminate
from .licenses import NOTICES, PHRASES, op12_license_scan, pieces
from .line_dedup import op10_line_dedup
from .merkle import op13_merkle_manifest
from .ngram_join import op2_ngram_jaccard
from .packing import op7_best_fit_packing
from .quality_cnn import op6_quality_classifier
from .quality_rules import op8_quality_rules
from .secrets import op9_secret_scan
from .substring_dedup import op3_substring_dedup
from .token_store import op5_token_store
from .warc import op4_warc_convert

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_ngram_jaccard, op3_substring_dedup, op4_warc_convert, op5_token_store, op6_quality_classifier, op7_best_fit_packing, op8_quality_rules, op9_secret_scan, op10_line_dedup, op11_phrase_collocations, op12_license_scan, op13_merkle_manifest)}

#: Lower-cases A-Z alone, as DuckDB's lower() would change other letters too.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: A part of a leaf: `-`, or the number of UTF-8 bytes, a colon and the value.
_PART = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0}, '-')"

ORACLE: dict[str, str] = {
    "op4_warc_convert": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op10_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (SELECT *, {_LOWER.format(r"trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM often)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (FROM often)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id""",
    "op8_quality_rules": rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
split AS (SELECT row, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
keyed AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM split),
often AS (
  SELECT host, key FROM keyed WHERE n > 0 GROUP BY ALL HAVING count(DISTINCT row) > 20),
gone AS (SELECT row, sum(n) AS n_gone FROM keyed WHERE n > 0 AND (host, key) IN (SELECT (host, key) FROM often) GROUP BY row),
dups AS (
  SELECT row, count(*) FILTER (n > 0 AND nth > 1) AS n_dup_lines
  FROM (SELECT row, n, row_number() OVER (PARTITION BY row, line ORDER BY i) AS nth FROM keyed) GROUP BY row),
base AS (
  SELECT row, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM docs),
tokens AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM base),
grams AS (
  SELECT row, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram
  FROM tokens WINDOW o AS (PARTITION BY row ORDER BY i)),
twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, gram) > 1 AND gram IS NOT NULL AS hit FROM grams),
covered AS (
  SELECT row, count(*) FILTER (hit) AS n_repeat_words
  FROM (SELECT row, bool_or(hit) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM twice) GROUP BY row),
counts AS (
  SELECT row, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols,
    n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_gone, 0) AS BIGINT) AS n_gone
  FROM base JOIN dups USING (row) LEFT JOIN covered USING (row) LEFT JOIN gone USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_gone >= n_words * 0.3 AS kept
FROM counts""",
    "op13_merkle_manifest": rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, *,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS inverse
  FROM documents),
text AS (SELECT *, CASE WHEN (4294967295 - inverse) % 5 = 0 THEN {_LOWER.format("text")} ELSE text END AS low FROM docs),
head AS (
  SELECT *, {_PART.format("doc_id")} || {_PART.format("source")} || {_PART.format("lang")} || {_PART.format("n_chars")} AS head FROM text),
leaves AS (SELECT r, doc_id, source, sha256(head || {_PART.format("text")}) AS leaf, sha256(head || {_PART.format("low")}) AS told FROM head),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
levels(source, lvl, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY place) FROM placed GROUP BY source
  UNION ALL
  SELECT source, lvl + 1, list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], '')))
  FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM levels WHERE len(nodes) = 1),
tops(lvl, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], '')))
  FROM tops WHERE len(nodes) > 1),
stations AS (
  SELECT r, lvl, nodes, CAST(p.place // CAST(pow(16, lvl) AS BIGINT) AS BIGINT) AS spot FROM placed p JOIN levels l ON l.source IS NOT DISTINCT FROM p.source WHERE len(nodes) > 1
  UNION ALL
  SELECT r, 100 + lvl, nodes, CAST(s.place // CAST(pow(16, lvl) AS BIGINT) AS BIGINT)
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source, tops WHERE len(nodes) > 1),
steps AS (
  SELECT r, lvl, array_to_string(nodes[spot - spot % 16 + 1 : spot], '') AS a, array_to_string(nodes[spot + 2 : spot - spot % 16 + 16], '') AS b FROM stations),
paths AS (SELECT r, list({{'a': a, 'b': b}} ORDER BY lvl) AS path FROM steps GROUP BY r),
joined AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root,
    coalesce(array_to_string(list_transform(path, lambda x: x.a || x.b), ''), '') AS siblings,
    list_reduce(list_prepend({{'a': p.told, 'b': ''}}, coalesce(path, [])), lambda y, x: {{'a': sha256(x.a || y.a || x.b), 'b': ''}}).a AS folded_root
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN paths USING (r))
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM joined""",
    "op12_license_scan": rf"""
WITH phrases(words, label) AS (VALUES {", ".join(f"(string_split('{p}', ' '), '{label}')" for p, label in PHRASES)}),
notices(notice, label, edits, pieces) AS (VALUES {", ".join(f"('{n}', '{label}', {e}, {[x for _, x in pieces(n, e)]})" for n, label, e in NOTICES)}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tokens AS (SELECT r, w, unnest(range(len(w))) AS i FROM docs),
places AS (SELECT r, i, label FROM tokens JOIN phrases p ON w[i + 1] = p.words[1] AND w[i + 1 : i + len(p.words)] = p.words),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r),
-- a notice is ASCII, so any other character counts as one that differs
hopeful AS (
  SELECT r, w, notice, label, edits
  FROM (SELECT r, w, regexp_replace(array_to_string(w, ' '), '[^\x00-\x7F]', '~', 'g') AS flat FROM docs) JOIN notices n ON len(list_filter(n.pieces, lambda p: contains(flat, p))) > 0),
starts AS (SELECT *, unnest(range(len(w))) AS i FROM hopeful),
runs AS (
  SELECT r, notice, label, edits, regexp_replace(array_to_string(w[i + 1 : i + n], ' '), '[^\x00-\x7F]', '~', 'g') AS run
  FROM starts, range(1, 22) lengths(n)
  WHERE i + n <= len(w) AND abs(n - len(string_split(notice, ' '))) <= edits),
near AS (SELECT r, label, 1 - levenshtein(run, notice) / length(notice) AS likeness FROM runs WHERE abs(length(run) - length(notice)) <= edits AND levenshtein(run, notice) <= edits),
fuzzy AS (SELECT r, list(DISTINCT label) AS labels, max(likeness) AS likeness FROM near GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(likeness, 0.0) END AS score
FROM docs LEFT JOIN base b USING (r) LEFT JOIN fuzzy f USING (r)""",
    "op11_phrase_collocations": rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, piece
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
tokens AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
counts AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM tokens, range(1, 6) orders(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
several AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
parts AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM several, range(2, 5) sizes(m), range(1, 5) starts(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT s.* FROM several s LEFT JOIN parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * f),
cuts AS (
  SELECT lang, phrase, f AS a, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 : k], ' ') AS rest FROM kept, range(1, 5) cuts(c) WHERE c < k),
scored AS (
  SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score, c
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head JOIN counts y ON y.lang = c.lang AND y.phrase = rest JOIN totals t ON t.lang = c.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
}
