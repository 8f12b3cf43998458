"""The registered queries as SQL for an independent engine.

Written from the meaning of each operator: pairs are formed by brute force and
components by a recursive query, unlike in the Spark plans.
"""

from __future__ import annotations

from postweave.plans.catalog import (
    ARRIVAL_DAYS, CLOSE, LATE_STEP, LOOK_BACK, N, NEW_BUCKET, REACH, STRAGGLERS, TOP, WINDOW_ARRIVAL, WINDOW_SECONDS)

WORD = r"[\p{L}\p{N}_]"
SPACE_SET = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
SPACE = f"[{SPACE_SET}]"
TOKEN = rf"[#@]?{WORD}+|[^\p{{L}}\p{{N}}_{SPACE_SET}]"
PUNCTUATION = rf"^[^\p{{L}}\p{{N}}_{SPACE_SET}]$"

POSTS = """
posts AS (
  SELECT source AS label, doc_id AS id, lang,
    CASE WHEN doc_id % 3 = 0 THEN 'RT ' ELSE '' END || text || ' #' || upper(lang[1]) || lang[2:]
      || 'Topic' || CAST(doc_id % 7 AS VARCHAR) || ' @' || source
      || ' https://ex.example/' || CAST(doc_id AS VARCHAR) AS text,
    DATE '2012-01-01' + CAST(doc_id * 37 % 1827 AS INTEGER) AS day
  FROM documents)"""

DATED = """
dated AS (
  SELECT label, id, text, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
    CAST(day(day) AS INTEGER) AS day
  FROM posts)"""

VECTORS = """
vecs AS (
  SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, 'post ' || CAST(vec_id AS VARCHAR) AS text,
    CAST(embedding AS DOUBLE[]) AS v,
    CAST(vec_id * 37 % 1827 + 734503 AS INTEGER) AS day_ordinal,
    CAST((vec_id * 37 % 1827) // 182 AS INTEGER) AS time_bucket,
    list_transform(range(0, len(embedding) // 8),
      lambda i: CAST(embedding[8 * i + 1 : 8 * i + 8] AS DOUBLE[])) AS words
  FROM embeddings),
fx AS (
  SELECT *, sqrt(list_dot_product(v, v)) AS n, words[1 : id % 4] AS tags FROM vecs)"""

SEES = {
    "reference": """(b.time_bucket IN (a.time_bucket, a.time_bucket + 1) OR (
        b.time_bucket = a.time_bucket - 1
        AND b.time_bucket = (SELECT min(time_bucket) FROM fx)))""",
    "symmetric": "abs(a.time_bucket - b.time_bucket) <= 1",
    "same_bucket": "a.time_bucket = b.time_bucket",
    "all": "true",
    "online": f"a.time_bucket >= {NEW_BUCKET}",
}


def _pairs(mode: str, posts: str = "true") -> str:
    return f"""{VECTORS.replace("FROM vecs)", f"FROM vecs WHERE {posts})")},
pairs AS (
  SELECT a.id AS src, b.id AS dst,
    round(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS d
  FROM fx a JOIN fx b ON a.id <> b.id AND {SEES[mode]})"""


def _near(mode: str = "reference", n: int = N, where: str = "true", posts: str = "true") -> str:
    return f"""{_pairs(mode, posts)},
near AS MATERIALIZED (
  SELECT src, dst, d FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS place
    FROM pairs WHERE {where}) WHERE place <= {n})"""


def _counts(mode: str) -> str:
    return f"""WITH {VECTORS}
SELECT a.id, a.time_bucket, count(b.id) AS n_candidates
FROM fx a LEFT JOIN fx b ON a.id <> b.id AND {SEES[mode]} GROUP BY a.id, a.time_bucket"""


def _close(mode: str = "reference") -> str:
    return f"""WITH {_pairs(mode)}
SELECT id, time_bucket, count(d) AS n_within
FROM fx LEFT JOIN pairs ON id = src AND d < {CLOSE} WHERE n > 0 GROUP BY id, time_bucket"""


def _neighbors(mode: str = "reference", n: int = N, where: str = "true") -> str:
    return f"WITH {_near(mode, n, where)} SELECT src, dst, round(d, 6) AS sentence_distance FROM near"


def _elements(column: str, k: int) -> str:
    return f"""
all_{column} AS MATERIALIZED (
  SELECT src, dst, list_sort(flatten(list_transform(range(len(a.{column})), lambda i:
    list_transform(range(len(b.{column})), lambda j: {{
      'd': round(1 - list_dot_product(a.{column}[i + 1], b.{column}[j + 1])
        / sqrt(list_dot_product(a.{column}[i + 1], a.{column}[i + 1])
          * list_dot_product(b.{column}[j + 1], b.{column}[j + 1])), 9), 'i': i, 'j': j}}))))[1:{k}] AS best
  FROM near JOIN fx a ON a.id = src JOIN fx b ON b.id = dst
  WHERE len(a.{column}) > 0 AND len(b.{column}) > 0),
best_{column} AS (
  SELECT src, dst, list_avg(list_transform(best, lambda x: x.d)) AS distance,
    array_to_string(list_transform(best, lambda x: CAST(x.i AS VARCHAR) || '-' || CAST(x.j AS VARCHAR)), ' ')
      AS couples
  FROM all_{column})"""


def _closest(column: str, k: int) -> str:
    return f"""WITH {_near()}, {_elements(column, k)}
SELECT near.src, near.dst, round(distance, 6) AS distance, couples
FROM near LEFT JOIN best_{column} e ON e.src = near.src AND e.dst = near.dst"""


def _labelled(extra: str = "") -> str:
    return f"""{_near()},
labelled AS (
  SELECT src, dst, d, CAST(a.label IS NOT DISTINCT FROM b.label AS INTEGER) AS label,
    CAST(d < {CLOSE} AS INTEGER) AS prediction
  FROM near JOIN fx a ON a.id = src JOIN fx b ON b.id = dst)"""


def _components(mode: str = "reference") -> str:
    return f"""{_near(mode)},
kept AS (SELECT src, dst FROM near WHERE d < {CLOSE}),
both_ways AS (SELECT src, dst FROM kept UNION SELECT dst, src FROM kept),
reached AS (
  SELECT id, id AS seen FROM fx
  UNION SELECT r.id, b.dst FROM reached r JOIN both_ways b ON b.src = r.seen),
topics AS (SELECT id, min(seen) AS component FROM reached GROUP BY id)"""


# Only posts with hashtags take part in learning.
TAGGED = "id % 4 > 0"

LEARNING = f"""{_near(posts=TAGGED)}, {_elements('words', 3)}, {_elements('tags', 9)},
labelled AS (
  SELECT near.src, near.dst, near.d, w.distance AS word_distance, t.distance AS hashtag_distance,
    CAST(a.label IS NOT DISTINCT FROM b.label AS INTEGER) AS label
  FROM near JOIN fx a ON a.id = near.src JOIN fx b ON b.id = near.dst
  JOIN best_words w ON w.src = near.src AND w.dst = near.dst
  JOIN best_tags t ON t.src = near.src AND t.dst = near.dst)"""

# Batches of events, the watermark of each, and what is timely and closed under it.
EVENTS = f"""
numbered AS (
  SELECT *, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400000000) AS INTEGER)
    // {ARRIVAL_DAYS} AS own FROM events),
arriving AS (
  SELECT *, CASE WHEN event_id % {STRAGGLERS} = 0 THEN (SELECT max(own) FROM numbered) ELSE own END AS batch,
    make_timestamp(epoch_us(ts) // {WINDOW_SECONDS}000000 * {WINDOW_SECONDS}000000) AS window_start
  FROM numbered),
marks AS (
  SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - INTERVAL 1 DAY AS watermark FROM arriving GROUP BY batch),
parted AS (
  SELECT a.*, coalesce(window_start + INTERVAL ({WINDOW_SECONDS}) SECOND <= watermark, false) AS late
  FROM arriving AS a JOIN marks USING (batch)),
timely AS (SELECT * FROM parted WHERE NOT late),
closed AS (
  SELECT * FROM timely WHERE window_start + INTERVAL ({WINDOW_SECONDS}) SECOND
    <= (SELECT max(ts) FROM arriving) - INTERVAL 1 DAY)"""

FLAT = rf"""{POSTS},
flat AS (
  SELECT *, regexp_replace(replace(
    regexp_replace(trim(text, 'RT'), '^{SPACE}+|{SPACE}+$', '', 'g'), chr(10), ' '),
    'http[^{SPACE_SET}]+', 'http', 'g') AS short
  FROM posts),
cleaned AS (
  SELECT *, regexp_replace(short, '@({WORD}+)', '@user', 'g') AS clean,
    lower(array_to_string(regexp_extract_all(short, '#({WORD}+)', 1), ', ')) AS hashtags,
    array_to_string(regexp_extract_all(short, '@({WORD}+)', 1), ', ') AS mentions
  FROM flat)"""

TOKENS = f"""{POSTS},
tokenised AS (SELECT id, regexp_extract_all(text, '{TOKEN}') AS token FROM posts)"""

ENCODED = f"""{TOKENS},
words AS (
  SELECT id, unnest(token) AS t, unnest(range(len(token))) AS pos FROM tokenised),
vocabulary AS (
  SELECT t, sha256(t) AS h FROM (SELECT DISTINCT t FROM words)),
encoded AS (
  SELECT t, list_transform(range(32), lambda i: CAST(CAST((CAST(
    (instr('0123456789abcdef', h[2 * i + 1]) - 1) * 16 + instr('0123456789abcdef', h[2 * i + 2]) - 1
    AS DOUBLE) - 127.5) / 127.5 AS FLOAT) AS DOUBLE)) AS v
  FROM vocabulary),
weighted AS (
  SELECT t, v, list_sum(list_transform(range(32), lambda i: v[i + 1] * (i + 1))) AS w FROM encoded)"""


def _positions(pattern: str) -> str:
    return f"""array_to_string(list_filter(list_transform(range(len(token)),
      lambda i: CASE WHEN regexp_matches(token[i + 1], '{pattern}') THEN i END),
      lambda i: i IS NOT NULL), ' ')"""


def _filtered(condition: str) -> str:
    return f"WITH {TOKENS} SELECT id, array_to_string(list_filter(token, lambda t: {condition}), ' ') AS tokens FROM tokenised"


def _vector_sum(condition: str) -> str:
    return f"""WITH {ENCODED}
SELECT p.id, count(w.t) AS n, round(coalesce(sum(w.w), 0), 4) AS checksum
FROM posts p LEFT JOIN (SELECT words.id, weighted.t, weighted.w FROM words JOIN weighted USING (t)
  WHERE {condition.replace('{t}', 'weighted.t')}) w ON w.id = p.id
GROUP BY p.id"""


LISTED = """
listed AS (SELECT 'quality-' || CAST(quality AS VARCHAR) AS label, doc_id AS id FROM labels)"""

ORACLES: dict[str, str] = {
    "load_posts": "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE text <> ''",
    "labelled_ids": """SELECT source || '.ids' AS label, CAST(doc_id AS VARCHAR) AS id
        FROM documents WHERE source <> 'src0'""",
    "saved_posts": f"WITH {POSTS}, {DATED} SELECT id, label, year, month, day, text FROM dated",
    "reloaded_stage": "SELECT doc_id AS id, source AS label FROM documents",
    "local_rows": "SELECT source AS label, count(*) AS posts FROM documents GROUP BY source",
    "finished_vectors": f"""WITH {VECTORS} SELECT id,
        round(list_sum(list_transform(range(len(v)), lambda i: v[i + 1] * (i + 1))), 4) AS checksum FROM fx""",
    "similar_to_vector": f"""WITH {VECTORS},
        parts AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM fx),
        means AS (SELECT pos, avg(x) AS m FROM parts GROUP BY pos),
        scored AS (SELECT id, sum(x * m) / sqrt(sum(x * x) * sum(m * m)) AS raw
          FROM parts JOIN means USING (pos) GROUP BY id)
        SELECT id, label, text, round(round(raw, 9), 2) AS similarity FROM scored JOIN fx USING (id)
        ORDER BY round(raw, 9) DESC, id LIMIT 10""",
    "hydrate_posts": f"""WITH {POSTS}, {DATED}, {LISTED}
        SELECT l.label, l.id, year, month, day, text FROM listed l JOIN dated USING (id)""",
    "keyword_search": f"""WITH {POSTS}, {DATED}
        SELECT d.id, d.year, d.month, d.day FROM dated d JOIN posts p ON p.id = d.id
        WHERE contains(p.text, 'tion') AND p.day <= DATE '2014-06-30'
        ORDER BY p.day DESC, d.id LIMIT 10""",
    "relabel_posts": f"""WITH {FLAT}, {LISTED}
        SELECT l.label, c.id, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
          CAST(day(day) AS INTEGER) AS day, mentions, hashtags
        FROM cleaned c JOIN listed l ON l.id = c.id""",
    "has_hashtags": f"""WITH {VECTORS}
        SELECT id, CAST(len(tags) AS INTEGER) AS n_hashtags FROM fx WHERE len(tags) > 0""",
    "hash_sample": """SELECT doc_id AS id, source AS label FROM documents
        WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT)
          < CAST(floor(0.05 * 4294967296) AS BIGINT)""",
    "sample_n": """SELECT doc_id AS id, source AS label FROM documents
        ORDER BY substr(md5(CAST(doc_id AS VARCHAR) || ':3'), 1, 8), doc_id LIMIT 100""",
    "split_edges": f"""WITH {_near()}
        SELECT src, dst, CASE WHEN (least(src, dst) * 31 + greatest(src, dst)) % 10 < 8
          THEN 'train' ELSE 'test' END AS split FROM near""",
    "slice_rows": f"WITH {POSTS} SELECT id, label FROM posts ORDER BY id LIMIT 50 OFFSET 20",
    "vertices": f"WITH {POSTS} SELECT id, label, text FROM posts",
    "clean_urls": rf"""WITH {POSTS}
        SELECT id, regexp_replace(text, 'http[^{SPACE_SET}]+', 'http', 'g') AS text FROM posts""",
    "strip_repost": f"WITH {POSTS} SELECT id, regexp_replace(text, '^RT ', '') AS text FROM posts",
    "extract_hashtags": f"""WITH {POSTS} SELECT id,
        lower(array_to_string(regexp_extract_all(text, '#({WORD}+)', 1), ', ')) AS hashtags FROM posts""",
    "split_hashtag": rf"""WITH {POSTS} SELECT id, array_to_string(list_transform(
        regexp_extract_all(text, '#({WORD}+)', 1), lambda x: trim(regexp_replace(
          regexp_replace(x, '([A-Z]?[a-z]+|[0-9]+)', ' \1 ', 'g'), '{SPACE}+', ' ', 'g'))), '|') AS words
        FROM posts""",
    "mask_mentions": f"""WITH {POSTS} SELECT id, regexp_replace(text, '@({WORD}+)', '@user', 'g') AS text,
        array_to_string(regexp_extract_all(text, '@({WORD}+)', 1), ', ') AS mentions FROM posts""",
    "clean_post": f"WITH {FLAT} SELECT id, clean AS text, hashtags, mentions FROM cleaned",
    "sentences": rf"""WITH {POSTS}, parts AS (
        SELECT id, list_filter(string_split(regexp_replace(text, '([.!?]){SPACE}+', '\1' || chr(1), 'g'),
          chr(1)), lambda x: x <> '') AS s FROM posts)
        SELECT id, CAST(unnest(range(len(s))) AS INTEGER) AS position, unnest(s) AS sentence FROM parts""",
    "tokens": f"""WITH {TOKENS} SELECT id, CAST(len(token) AS INTEGER) AS n_tokens,
        array_to_string(token, ' ') AS tokens FROM tokenised""",
    "token_positions": f"""WITH {TOKENS} SELECT id, {_positions('^#')} AS hashtag_idxs,
        {_positions('^@')} AS mentions_idxs, {_positions(PUNCTUATION)} AS punctuation_idxs
        FROM tokenised""",
    "replace_tokens": f"""WITH {TOKENS} SELECT id, array_to_string(list_transform(token,
        lambda t: CASE WHEN t[1] = '#' THEN t ELSE '-' END), ' ') AS tokens FROM tokenised""",
    "select_by_index": _filtered(f"regexp_matches(t, '{PUNCTUATION}')"),
    "remove_by_index": _filtered(f"NOT regexp_matches(t, '{PUNCTUATION}')"),
    "hashtag_tokens": f"""WITH {TOKENS} SELECT id, array_to_string(list_transform(
        list_filter(token, lambda t: t[1] = '#'), lambda t: lower(t[2:])), ' ') AS hashtags
        FROM tokenised""",
    "text_with_info": f"""WITH {POSTS}
        SELECT id, concat_ws(' <sep> ', text, year(day), month(day), day(day),
          lower(array_to_string(regexp_extract_all(text, '#({WORD}+)', 1), ', ')),
          array_to_string(regexp_extract_all(text, '@({WORD}+)', 1), ', ')) AS text_with_info
        FROM posts""",
    "word_vectors": f"""WITH {ENCODED}
        SELECT t AS token, n, round(w, 4) AS checksum
        FROM weighted JOIN (SELECT t, count(*) AS n FROM words GROUP BY t) USING (t)""",
    "sentence_vectors": f"""WITH {ENCODED}
        SELECT id, round(avg(w), 4) AS checksum FROM words JOIN weighted USING (t) GROUP BY id""",
    "hashtag_vectors": _vector_sum("{t}[1] = '#'"),
    "drop_punctuation_vectors": _vector_sum("NOT regexp_matches({t}, '" + PUNCTUATION + "')"),
    "day_ordinal": f"""WITH {POSTS}
        SELECT id, CAST(day - DATE '2012-01-01' + 734503 AS INTEGER) AS day_ordinal FROM posts""",
    "date_bucket": f"""WITH {POSTS}
        SELECT id, CAST(day - DATE '2012-01-01' + 734503 AS INTEGER) AS day_ordinal,
          CAST((day - DATE '2012-01-01') // 182 AS INTEGER) AS time_bucket FROM posts""",
    "width_bucket": f"WITH {VECTORS} SELECT id, CAST(day_ordinal // 30 AS INTEGER) AS bucket FROM fx",
    "date_parts": """SELECT event_id, CAST(year(ts) AS INTEGER) AS year,
        CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day FROM events""",
    "bucket_pairs": _counts("reference"),
    "same_bucket_pairs": _counts("same_bucket"),
    "symmetric_pairs": _counts("symmetric"),
    "threshold_pairs": _neighbors("all", N, f"d < {REACH}"),
    "online_pairs": f"""WITH {VECTORS} SELECT a.id, count(*) AS n_candidates
        FROM fx a JOIN fx b ON a.id <> b.id AND {SEES['online']} GROUP BY a.id""",
    "close_pairs": _close(),
    "close_pairs_same_bucket": _close("same_bucket"),
    "online_close_pairs": f"""WITH {_pairs("online")} SELECT id, count(d) AS n_within
        FROM fx LEFT JOIN pairs ON id = src AND d < {CLOSE}
        WHERE n > 0 AND time_bucket >= {NEW_BUCKET} GROUP BY id""",
    "online_neighbors": _neighbors("online"),
    "cosine_distance": f"""WITH {VECTORS} SELECT a.id,
        round(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS cosine_distance
        FROM fx a JOIN fx b ON b.id = a.id + 1""",
    "nearest_neighbors": _neighbors(),
    "nearest_neighbors_symmetric": _neighbors("symmetric"),
    "nearest_neighbors_same_bucket": _neighbors("same_bucket"),
    "knn_all": _neighbors("all", 3),
    "most_similar": f"""WITH {VECTORS},
        alike AS (SELECT max_by(b.id, b.id) AS id, max_by(b.label, b.id) AS label, b.text,
          max_by(round(list_dot_product(a.v, b.v) / (a.n * b.n), 9), b.id) AS raw
          FROM fx a JOIN fx b ON a.id = 10 AND b.id <> 10 GROUP BY b.text)
        SELECT id, label, text, round(raw, 2) AS similarity FROM alike
        ORDER BY raw DESC, id LIMIT 10""",
    "closest_words": _closest("words", 3),
    "closest_hashtags": _closest("tags", 9),
    "attach_arrays": f"""WITH {_near()}, sums AS (
        SELECT id, round(list_sum(list_transform(words, lambda v: list_sum(list_transform(
          range(len(v)), lambda i: v[i + 1] * (i + 1))))), 4) AS checksum FROM fx)
        SELECT src, dst, a.checksum, b.checksum AS checksum_2
        FROM near LEFT JOIN sums a ON a.id = src LEFT JOIN sums b ON b.id = dst""",
    "neighbor_lists": f"""WITH {_near()}
        SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY d, dst) AS ids,
          round(sum(d), 6) AS total FROM near GROUP BY src""",
    "label_counts": "SELECT source AS label, count(*) AS posts FROM documents GROUP BY source",
    "neighbor_histogram": f"""WITH {_near()}
        SELECT CAST(n AS INTEGER) AS size, count(*) AS posts
        FROM (SELECT src, count(*) AS n FROM near GROUP BY src) GROUP BY n""",
    "describe_posts": f"WITH {VECTORS} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
        round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS stddev, CAST(min({c}) AS VARCHAR) AS min,
        CAST(max({c}) AS VARCHAR) AS max FROM fx""" for c in ("id", "day_ordinal", "time_bucket", "label")),
    "in_degrees": f"WITH {_near()} SELECT dst AS id, count(*) AS in_degree FROM near GROUP BY dst",
    "confusion": f"""WITH {_labelled()}, c AS (
        SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp,
          count(*) FILTER (label = 0 AND prediction = 0) AS tn,
          count(*) FILTER (label = 1 AND prediction = 0) AS fn,
          count(*) FILTER (label = 0 AND prediction = 1) AS fp FROM labelled)
        SELECT tp, tn, fn, fp, round((tp + tn) / (tp + tn + fn + fp), 6) AS accuracy,
          round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
          round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "auroc": f"""WITH {_labelled()}
        SELECT round(avg(CASE WHEN p.d < q.d THEN 1.0 WHEN p.d = q.d THEN 0.5 ELSE 0.0 END), 6) AS auroc
        FROM labelled p JOIN labelled q ON p.label = 1 AND q.label = 0""",
    "indexed_exact": f"""WITH {_near('all', 10)}
        SELECT src, dst, round(d, 6) AS sentence_distance FROM near WHERE src % 50 = 0""",
    "indexed_neighbors": f"WITH {VECTORS} SELECT id AS src, true AS recalled FROM fx WHERE id % 50 = 0",
    "colocated_edges": f"""WITH {_near()}
        SELECT src, dst, label, count(*) OVER (PARTITION BY src) AS out_degree, true AS unmoved
        FROM near JOIN fx ON id = src""",
    "precision_recall": f"""WITH {_labelled()},
        counted AS (
          SELECT least(CAST(floor(round((1 - d / 2) * 1000, 6)) AS INTEGER), 999) AS bin,
            count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM labelled GROUP BY bin),
        summed AS (
          SELECT bin, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
            sum(pos) OVER () AS every
          FROM counted WINDOW w AS (ORDER BY bin DESC))
        SELECT bin, round(bin / 1000, 6) AS threshold, tp, fp, round(tp / (tp + fp), 6) AS precision,
          round(tp / every, 6) AS recall FROM summed""",
    "balanced_edges": f"""WITH {LEARNING}
        SELECT src, dst, label, true AS reached, true AS balanced,
          CASE WHEN (least(src, dst) * 31 + greatest(src, dst)) % 10 >= 8 THEN 'test' ELSE 'train' END AS split
        FROM labelled""",
    "count_vectors": f"""WITH {TOKENS}
        SELECT word AS token, count(*) AS n, true AS embedded, true AS apart
        FROM (SELECT unnest(token) AS word FROM tokenised) GROUP BY word""",
    "stream_sample": """SELECT doc_id AS id, source AS label FROM documents
        ORDER BY substr(md5(CAST(doc_id AS VARCHAR) || ':3'), 1, 8), doc_id LIMIT 100""",
    "row_index": """SELECT doc_id AS id, source AS label, row_number() OVER (ORDER BY doc_id) AS index
        FROM documents""",
    "union_posts": f"WITH {VECTORS} SELECT id, label, time_bucket FROM fx",
    "proximity_edges": f"""WITH {_near()}, {_elements('words', 3)}, {_elements('tags', 9)}
        SELECT near.src, near.dst, round(near.d, 6) AS sentence_distance,
          round(w.distance, 6) AS word_distance, round(t.distance, 6) AS hashtag_distance
        FROM near LEFT JOIN best_words w ON w.src = near.src AND w.dst = near.dst
        LEFT JOIN best_tags t ON t.src = near.src AND t.dst = near.dst""",
    "edge_labels": f"""WITH {_labelled()}
        SELECT src, dst, round(d, 6) AS sentence_distance, label FROM labelled""",
    "undirected_edges": f"""WITH {_near()}
        SELECT src, dst FROM near UNION SELECT dst, src FROM near""",
    "dangling_edges": f"""WITH {_near()}
        SELECT src, dst FROM near JOIN fx a ON a.id = src JOIN fx b ON b.id = dst
        WHERE len(a.tags) = 0 OR len(b.tags) = 0""",
    "connected_components": f"WITH RECURSIVE {_components()} SELECT id, component FROM topics",
    "topic_summary": f"""WITH RECURSIVE {_components()}, counted AS (
        SELECT component, label, count(*) AS n FROM topics JOIN fx USING (id) GROUP BY component, label),
        ranked AS (SELECT *, sum(n) OVER (PARTITION BY component) AS size,
          row_number() OVER (PARTITION BY component ORDER BY n DESC, label) AS place FROM counted)
        SELECT component, CAST(size AS BIGINT) AS size, label AS majority_label,
          round(n / size, 6) AS purity FROM ranked WHERE place = 1""",
    "label_index": """SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
        FROM (SELECT DISTINCT source AS label FROM documents)""",
    "vertex_labels": """SELECT doc_id AS id, source AS label,
        CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_idx FROM documents""",
    "assign_centroid": f"""WITH {VECTORS}, parts AS (
        SELECT id, label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM fx),
        means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY label, pos),
        gaps AS (SELECT p.id, p.label AS own, m.label, sqrt(sum((x - m) * (x - m))) AS d
          FROM parts p JOIN means m ON m.pos = p.pos GROUP BY p.id, p.label, m.label),
        reach AS (SELECT label, avg(d) AS r, row_number() OVER (ORDER BY label) - 1 AS place
          FROM gaps WHERE own = label GROUP BY label)
        SELECT id, CAST(coalesce(min(CASE WHEN round(d, 9) < round(r, 9) THEN place END), -1) AS INTEGER)
          AS cluster FROM gaps JOIN reach USING (label) GROUP BY id""",
    "score_edges": f"""WITH {LEARNING}
        SELECT src, dst, round(d, 6) AS sentence_distance, round(word_distance, 6) AS word_distance,
          round(hashtag_distance, 6) AS hashtag_distance, label, true AS consistent,
          CASE WHEN (least(src, dst) * 31 + greatest(src, dst)) % 10 >= 8 THEN 'test' ELSE 'train' END AS split
        FROM labelled""",
    "cut_edges": f"""WITH {LEARNING}
        SELECT src, dst, label, true AS all_scored, true AS purer FROM labelled WHERE d < {CLOSE}""",
    "classify_topics": f"""WITH {VECTORS}
        SELECT id, label, CAST(place AS INTEGER) AS label_idx, true AS known
        FROM (SELECT id, label, dense_rank() OVER (ORDER BY label) - 1 AS place FROM fx)""",
    "kmeans_topics": f"WITH {VECTORS} SELECT id, label, true AS settled, true AS in_range FROM fx",
    "searched_classifier": f"""WITH {LEARNING}
        SELECT src, dst, label, true AS same, true AS tried
        FROM labelled WHERE (least(src, dst) * 31 + greatest(src, dst)) % 10 >= 8""",
    "pca3_with_vector": f"""WITH {VECTORS} SELECT id, label, CAST(NULL AS BOOLEAN) AS at_origin FROM fx
        UNION ALL SELECT -1, 'new', true""",
    "pca3": f"""WITH {VECTORS} SELECT id, label, CAST(3 AS INTEGER) AS components, true AS in_order,
        true AS uncorrelated, true AS centred FROM fx""",
    "language_id": f"WITH {POSTS} SELECT id, lang, true AS accurate FROM posts",
    "approx_neighbors": f"WITH {VECTORS} SELECT id, true AS within, true AS recalled FROM fx",
    "topics_of_texts": f"WITH {POSTS} SELECT id, true AS well_named, true AS known FROM posts",
    "stream_scored_topics": f"""WITH {VECTORS} SELECT id, true AS well_named, true AS known FROM fx
        WHERE time_bucket >= {NEW_BUCKET} AND {TAGGED}""",
    "nearest_neighbors_blocks": f"""WITH {VECTORS.replace("fx AS (", "single AS (")},
        fx AS (SELECT id, time_bucket, v, sqrt(list_dot_product(v, v)) AS n FROM (
          SELECT id, time_bucket, v FROM single UNION ALL
          SELECT id + 1000000, time_bucket, list_transform(v, lambda x, i: CAST(CAST(
            x + CASE WHEN i - 1 = id % 64 THEN 1e-4 ELSE 0 END AS FLOAT) AS DOUBLE)) FROM single)),
        pairs AS (
          SELECT a.id AS src, b.id AS dst, round(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS d
          FROM fx a JOIN fx b ON a.id <> b.id AND a.time_bucket = b.time_bucket)
        SELECT src, dst, round(d, 6) AS sentence_distance FROM (
          SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS place FROM pairs)
        WHERE place <= {N}""",
    "stream_ingest": f"""WITH {POSTS}
        SELECT id, label, regexp_replace(text, '^RT ', '') AS text FROM posts""",
    "stream_enrich": f"""WITH {FLAT}
        SELECT id, clean AS text, hashtags, mentions,
          CAST((day - DATE '2012-01-01') // 182 AS INTEGER) AS time_bucket,
          CAST(len(regexp_extract_all(clean, '{TOKEN}')) AS INTEGER) AS n_tokens FROM cleaned""",
    "stream_neighbors": _neighbors("symmetric"),
    "stream_topics": f"WITH RECURSIVE {_components('symmetric')} SELECT id, component FROM topics",
    "late_posts": f"""WITH {VECTORS} SELECT id + 1000000 AS id, time_bucket FROM fx
        WHERE time_bucket % {LATE_STEP} = 0 AND time_bucket < (SELECT max(time_bucket) FROM fx) - 1""",
    "stream_components": f"""WITH RECURSIVE {_components()}
        SELECT id, component FROM topics
        WHERE id IN (SELECT src FROM kept UNION SELECT dst FROM kept)""",
    "stream_forest": f"""WITH RECURSIVE {_components()}
        SELECT id, component FROM topics
        WHERE id IN (SELECT src FROM kept UNION SELECT dst FROM kept)""",
    "window_components": f"""WITH RECURSIVE {_near()},
        dated AS (
          SELECT src, dst, least(a.time_bucket, b.time_bucket) AS older, greatest(a.time_bucket, b.time_bucket) AS newer
          FROM near JOIN fx a ON a.id = src JOIN fx b ON b.id = dst WHERE d < {CLOSE}),
        steps AS (SELECT newer // {WINDOW_ARRIVAL} AS batch, max(newer) AS newest FROM dated GROUP BY 1),
        alive AS (
          SELECT batch, src, dst FROM steps JOIN dated ON newer <= newest AND older >= newest - {LOOK_BACK}),
        pairs_both AS (SELECT batch, src, dst FROM alive UNION SELECT batch, dst, src FROM alive),
        reach AS (
          SELECT batch, src AS id, src AS seen FROM pairs_both
          UNION SELECT r.batch, r.id, b.dst FROM reach r JOIN pairs_both b ON b.batch = r.batch AND b.src = r.seen)
        SELECT id, min(seen) AS component, CAST(batch AS INTEGER) AS batch FROM reach GROUP BY batch, id""",
    "event_windows": f"""WITH {EVENTS}
        SELECT window_start, event_type, count(*) AS events, round(sum(value), 2) AS total
        FROM closed GROUP BY window_start, event_type""",
    "late_events": f"WITH {EVENTS} SELECT event_id, ts FROM parted WHERE late",
    "event_candidates": f"""WITH {EVENTS}
        SELECT a.event_id, a.user_id, count(*) AS candidates FROM timely AS a JOIN closed AS b
          ON a.user_id = b.user_id AND b.window_start IN (
            a.window_start, a.window_start - INTERVAL ({WINDOW_SECONDS}) SECOND)
        WHERE a.event_type = 'purchase' AND b.event_type IN ('view', 'click') GROUP BY a.event_id, a.user_id""",
    "event_tops": f"""WITH {EVENTS}
        SELECT window_start, event_type, place, event_id, value FROM (
          SELECT *, row_number() OVER (PARTITION BY window_start, event_type ORDER BY value DESC, event_id) AS place
          FROM closed) WHERE place <= {TOP}""",
}
