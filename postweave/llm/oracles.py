"""The same results in SQL, where SQL can express them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP4 = f"""
WITH lines AS (
    SELECT doc_id, i AS position, string_split(coalesce(text, ''), chr(10))[i] AS line
    FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
keyed AS (
    SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM lines),
frequent AS (
    SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE f.key IS NULL), ''))
        AS kept_sha256
FROM keyed LEFT JOIN frequent AS f ON keyed.key = f.key GROUP BY doc_id
"""

_WORDS = (f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
          "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')")

_OP9 = f"""
WITH doc_words AS (SELECT DISTINCT doc_id, {_WORDS} AS words FROM documents),
item_words AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
cut AS (
    SELECT DISTINCT item_id, words[i:i + 9] AS w
    FROM item_words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS u(i) WHERE len(words) > 0),
lengths AS (SELECT DISTINCT len(w) AS size FROM cut),
places AS (
    SELECT doc_id, i, size, words[i:i + size - 1] AS w
    FROM doc_words, lengths, unnest(range(1, len(words) - size + 2)) AS u(i)),
hits AS (SELECT p.doc_id, p.i, p.size, c.item_id FROM places AS p JOIN cut AS c ON p.w = c.w),
hit_words AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit
    FROM (SELECT DISTINCT doc_id, i, size FROM hits), unnest(range(i, i + size)) AS u(j)
    GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words AS d LEFT JOIN hit_words AS h ON d.doc_id = h.doc_id
LEFT JOIN hit_items AS i ON d.doc_id = i.doc_id
"""

_SPACE_RUN = "'[\\x20\\x09-\\x0D]+'"

_OP1 = f"""
WITH docs AS (
    SELECT DISTINCT doc_id, source, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), {_SPACE_RUN}), lambda w: w <> '') AS words
    FROM documents),
lines AS (
    SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line
    FROM docs, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
worded AS (
    SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}123456789', '{_LOWER}000000000') AS plain
    FROM lines WHERE trim(line, {_SPACES}) <> ''),
copies AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
frequent AS (
    SELECT source, plain FROM worded GROUP BY source, plain HAVING count(DISTINCT doc_id) > 20),
removed AS (
    SELECT doc_id, sum(len(string_split_regex(w.plain, {_SPACE_RUN}))) AS n_removed_words
    FROM worded AS w JOIN frequent AS f ON w.source IS NOT DISTINCT FROM f.source AND w.plain = f.plain
    GROUP BY doc_id),
windows AS (
    SELECT doc_id, i, words[i:i + 2] AS w FROM docs, unnest(range(1, len(words) - 1)) AS u(i)),
twice AS (
    SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeats AS (
    SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM twice, unnest(range(i, i + 3)) AS u(j)
    GROUP BY doc_id),
counted AS (
    SELECT d.doc_id, len(words) AS n_words,
        length(regexp_replace(text, {_SPACE_RUN}, '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
    FROM docs AS d LEFT JOIN copies AS c ON d.doc_id = c.doc_id
    LEFT JOIN repeats AS r ON d.doc_id = r.doc_id LEFT JOIN removed AS g ON d.doc_id = g.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
        AND NOT 100 * (n_words - n_removed_words) < 50 * n_words AS kept
FROM counted
"""

_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"

_OP6 = f"""
WITH hosts AS (
    SELECT page_id, url, nullif({_HOST}, '') AS host, string_split({_HOST}, '.') AS labels FROM pages),
keyed AS (
    SELECT page_id, url, host, list_transform(
        range(1, greatest(len(labels) - 1, 1) + 1),
        lambda i: array_to_string(labels[i:len(labels)], '.')) AS keys,
        epoch_ms((1704067200 + (page_id * 7919) % 527040 * 60) * 1000) AS fetched,
        epoch_ms((1704067200 + (page_id * 104729) % 527040 * 60) * 1000) AS entered
    FROM hosts),
entries AS (
    SELECT CASE WHEN md5(url)[2:2] < '8' OR len(keys) < 2 THEN keys[1] ELSE keys[len(keys) - 1] END AS key,
        entered, max(md5(url)[1:1] < '8') AS listed
    FROM keyed WHERE host IS NOT NULL GROUP BY 1, 2),
asked AS (
    SELECT page_id, fetched, unnest(keys) AS key FROM keyed WHERE host IS NOT NULL),
held AS (
    SELECT a.page_id, count(*) FILTER (WHERE e.listed) AS n_listed
    FROM asked AS a ASOF JOIN entries AS e ON a.key = e.key AND a.fetched >= e.entered GROUP BY a.page_id)
SELECT k.page_id, host, fetched, coalesce(n_listed, 0) AS n_listed, coalesce(n_listed, 0) > 0 AS blocked
FROM keyed AS k LEFT JOIN held AS h ON k.page_id = h.page_id
"""

_OP10 = f"""
WITH RECURSIVE docs AS (
    SELECT DISTINCT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_SPACE_RUN}), lambda w: w <> '') AS words
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
    FROM docs, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS u(i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
    FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM pairs JOIN sizes AS a ON a.doc_id = x JOIN sizes AS b ON b.doc_id = y
    WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
reached AS (
    SELECT doc_id AS id, doc_id AS seen FROM docs
    UNION SELECT r.id, l.y FROM reached AS r JOIN links AS l ON l.x = r.seen),
least AS (SELECT id, min(seen) AS component_id FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs AS d JOIN least ON id = d.doc_id LEFT JOIN sizes AS z ON z.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {
    "op1_line_quality": _OP1,
    "op4_line_dedup": _OP4,
    "op6_url_lists": _OP6,
    "op9_decontamination": _OP9,
    "op10_ngram_join": _OP10,
}
