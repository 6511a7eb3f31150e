"""DuckDB SQL for the queries that SQL can express; the others are tested by brute force."""

from __future__ import annotations

from areacast.llm.quality import RULES, STOP_WORDS, SYMBOLS

_BREAK = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_BREAK}'), lambda w: w <> '')"


def _rules() -> str:
    parts = []
    for r in RULES:
        parts += [f"{r.metric} >= {r.low}"] if r.low is not None else []
        parts += [f"{r.metric} <= {r.high}"] if r.high is not None else []
    return " AND ".join(parts)


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_words(
      "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
  )} AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT x AS doc_id, y AS other FROM links
  UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
  least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) r USING (doc_id)
"""

QUALITY = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), dup AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)
  ) WHERE c >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS c FROM dup, range(8) r(j) GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(w) AS n_words,
    length(regexp_replace(t, '{_BREAK}', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
    length(t) - length(translate(t, '!', '')) AS n_exclaim,
    len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words,
    len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOP}))) AS n_stop_words,
    coalesce(c, 0) AS n_repeat_words
  FROM t LEFT JOIN covered USING (doc_id)
), rated AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars,
    n_symbols / greatest(n_words, 1) AS symbol_ratio,
    n_exclaim / greatest(n_words, 1) AS exclaim_ratio,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
    n_letter_words / greatest(n_words, 1) AS letter_word_ratio,
    n_stop_words / greatest(n_words, 1) AS stop_word_ratio,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_rules()} AS kept
FROM rated
"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win), range(13) r(j)
  WHERE first < doc_id
), word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

MIX = f"""
WITH d AS (
  SELECT doc_id, source, len({_words("coalesce(text, '')")}) AS size,
    CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT)
      / 1099511627776.0::DOUBLE AS place
  FROM documents
), sl AS (
  SELECT source, CAST(floor(place * 4096) AS INTEGER) AS slice, sum(size)::BIGINT AS n
  FROM d GROUP BY 1, 2
), s AS (
  SELECT source, sum(n)::BIGINT AS source_size,
    [1.0, 2.0, 3.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sl GROUP BY source
), lev AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0))
      / sum(weight) OVER onward AS level,
    row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS n
  FROM s
  WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), tgt AS (
  SELECT source, source_size,
    least(cap, coalesce(
      weight * (SELECT arg_min(level, n) FROM lev WHERE cap > weight * level), cap)) AS target
  FROM lev
), need AS (
  SELECT *, target / greatest(source_size, 1) AS times,
    (target / greatest(source_size, 1) - floor(target / greatest(source_size, 1))) * source_size
      AS need
  FROM tgt
), cut AS (
  SELECT source, (max_by(slice, slice) + max_by(part, slice)) / 4096 AS cut
  FROM (
    SELECT r.source, slice, least((need - before) / n, 1.0::DOUBLE) AS part
    FROM (SELECT source, slice, n, coalesce(sum(n) OVER (
            PARTITION BY source ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
          ), 0) AS before FROM sl) r
    JOIN need ON need.source IS NOT DISTINCT FROM r.source
    WHERE before <= need AND n > 0
  ) GROUP BY source
)
SELECT d.doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * least(3, floor(times) + CASE WHEN place < coalesce(cut, 0) THEN 1 ELSE 0 END)
       AS BIGINT) AS taken
FROM d JOIN need ON need.source IS NOT DISTINCT FROM d.source
LEFT JOIN cut ON cut.source IS NOT DISTINCT FROM d.source
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p)
WHERE r <= 10
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(
    text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), sized AS (
  SELECT lang, w, unnest([1, 2, 3]) AS k FROM words WHERE len(w) > 0
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY 1, 2, 3
), n AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1
), cand AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
    FROM cand WHERE k = 3) GROUP BY 1, 2
), cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, p.a AS l, q.a AS r,
    ((1000000::HUGEINT * c.a * c.a) // (p.a::HUGEINT * q.a))::BIGINT AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = c.x JOIN f q ON q.lang = c.lang AND q.phrase = c.y
), best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM scored)
  WHERE place = 1
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer g ON b.k = 2 AND g.lang = b.lang AND g.phrase = b.phrase
  WHERE g.longer IS NULL OR 100 * g.longer < 50 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": JACCARD,
    "op4_threshold_rules": QUALITY,
    "op5_substring_dedup": SUBSTRING,
    "op6_source_mix": MIX,
    "op8_block_top_k": TOP_K,
    "op13_phrase_collocations": COLLOCATIONS,
}
