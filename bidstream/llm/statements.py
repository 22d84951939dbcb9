"""DuckDB statements of the registered queries that SQL can express."""

_WORDS = r"[^\x20\x09-\x0D]+"

OP1_MIXING = rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size,
           md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
           2.0::DOUBLE * source_size AS most
    FROM sources
), levels AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighed
    WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT source, source_size,
           least(most, coalesce(max(CASE WHEN level * weight <= most THEN level END) OVER () * weight, most)) AS target
    FROM levels
), placed AS (
    SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
           CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
           sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken
FROM placed
"""

OP2_NEAR_DEDUP = rf"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '{_WORDS}') AS words
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles
    FROM worded
), flat AS (
    SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), coded AS (
    SELECT doc_id, n, dense_rank() OVER (ORDER BY shingle) AS shingle FROM flat
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM coded a JOIN coded b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    WHERE 85 * a.n <= 100 * b.n AND 85 * b.n <= 100 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id)
"""

OP3_NEIGHBOURS = """
WITH usable AS (
    SELECT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
    FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER nearest)::INTEGER AS rank, vec_id, score FROM scored
WINDOW nearest AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER nearest <= 5
"""

_PHRASES = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies",
    "enable javascript", "lorem ipsum", "click here", "skip to content", "back to top",
)
_FURNITURE = " OR ".join(f"contains(lower(x), '{p}')" for p in _PHRASES)
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _count(text, characters):
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


OP5_LINE_QUALITY = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM documents
), windows AS (
    SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM texts WHERE len(words) >= 3
), keyed AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM windows
), repeated AS (
    SELECT doc_id, count(DISTINCT place)::BIGINT AS n_repeat_words
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM keyed WHERE n > 1) GROUP BY doc_id
), lined AS (
    SELECT doc_id, words, text, length(translate(text, {_SPACES}, '')) AS word_chars,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS lines
    FROM texts
), judged AS (
    SELECT *, list_filter(list_distinct(lines), lambda x: NOT (
        {_count('x', '!?')} > len(regexp_extract_all(x, '{_WORDS}'))
        OR (len(regexp_extract_all(x, '{_WORDS}')) < 3
            AND NOT contains('.!?:;,"'')]', right(rtrim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    ')), 1)))
        OR 4 * {_count('x', '#*$%&|<>')} > len(regexp_extract_all(x, '{_WORDS}'))
        OR ({_count('x', '|>»•·')} >= 2 AND 4 * {_count('x', '|>»•·')} > len(regexp_extract_all(x, '{_WORDS}')))
        OR {_FURNITURE})) AS good
    FROM lined
), counted AS (
    SELECT j.doc_id, len(words)::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
           {_count('text', '#*$%&|<>')}::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
           (word_chars - coalesce(list_sum(list_transform(good, lambda x: length(translate(x, {_SPACES}, '')))), 0))::BIGINT AS lost_chars
    FROM judged j LEFT JOIN repeated r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * lost_chars > 50 * word_chars) AS kept
FROM counted
"""


def _round_of(n):
    """A round over codebooks b{n}: nearest entries a{n}, and the codebooks after it."""
    return f"""
, d{n} AS (
    SELECT v.row, v.part, b.entry, sum((v.x - b.x) ** 2)::BIGINT AS distance
    FROM components v JOIN b{n} b USING (part, place) GROUP BY v.row, v.part, b.entry
), a{n} AS (
    SELECT row, part, min({{'d': distance, 'e': entry}}) AS best FROM d{n} GROUP BY row, part
), b{n + 1} AS (
    SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x
    FROM b{n} b LEFT JOIN (
        SELECT part, a.best.e AS entry, place, floor(sum(v.x)::HUGEINT / count(*))::BIGINT AS x
        FROM components v JOIN a{n} a USING (row, part) GROUP BY part, a.best.e, place
    ) m USING (part, entry, place)
)"""


_KEPT = """len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0"""

OP11_VECTOR_CODES = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
           list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
    FROM embeddings WHERE {_KEPT}
), flat AS (
    SELECT row, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) // 16 AS size FROM kept
), components AS (
    SELECT row, x, (i // size)::INT AS part, (i % size)::INT AS place FROM flat
), b0 AS (
    SELECT part, (row - 1)::INT AS entry, place, x FROM components WHERE row <= 64
){_round_of(0)}{_round_of(1)}{_round_of(2)}
, books AS (
    SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b2
), coded AS (
    SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY row
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), books
"""

_ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
           r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)")
_PATTERNS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
             "entropy_hex": "[0-9A-Fa-f]{16,}", "entropy_base64": "[0-9A-Za-z+/_-]{20,}"}


def _matches(number, kind, pattern):
    value = f"regexp_extract_all(text, '{pattern}', 2)" if kind == "assign" else "matches"
    return f"""
    SELECT row, {number} AS kind, unnest(matches) AS m, unnest({value}) AS value,
           unnest(string_split_regex(text, '{pattern}')[:-2]) AS gap, unnest(range(len(matches))) AS i
    FROM (SELECT row, text, regexp_extract_all(text, '{pattern}') AS matches FROM texts) WHERE len(matches) > 0"""


def _entropic(number, window, bits):
    from bidstream.llm.secret_scan import most_terms, terms

    return f"""
    SELECT row, {number} AS kind, min(start + j - 1) AS start, max(start + j - 1) + {window} AS stop
    FROM (SELECT row, start, m, unnest(range(1, length(m) - {window} + 2)) AS j FROM candidates WHERE kind = {number})
    WHERE list_sum(list_transform(list_distinct(string_split(substring(m, j, {window}), '')), lambda c:
        {terms(window)}[1 + {window} - length(replace(substring(m, j, {window}), c, ''))])) <= {most_terms(window, bits)}
    GROUP BY row, start"""


OP12_SECRET_SCAN = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), matched AS ({" UNION ALL ".join(_matches(n, k, p) for n, (k, p) in enumerate(_PATTERNS.items()))}
), placed AS (
    SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY row, kind ORDER BY i) - length(m))::BIGINT AS start FROM matched
), candidates AS (
    SELECT * FROM placed
    WHERE kind >= 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
      AND NOT regexp_full_match(m, '[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}')
      AND NOT regexp_matches(lower(m), 'example|sample|dummy|placeholder|changeme|0123456789|abcdefgh|xxxx')
      AND (kind = 3 OR regexp_matches(m, '[^0-9A-Fa-f]'))
), spans AS (
    SELECT row, kind, start, start + length(m) AS stop FROM placed
    WHERE (kind = 0 AND length(value) >= 8) OR (kind = 1 AND length(m) >= 16) OR (kind = 2 AND length(m) >= 32)
    UNION ALL {_entropic(3, 16, 2.9)}
    UNION ALL {_entropic(4, 20, 3.7)}
), listed AS (
    SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           count(*) FILTER (kind > 2) AS n_entropy, string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
           string_agg(s, ',' ORDER BY start, kind) AS spans
    FROM (SELECT *, {list(_PATTERNS)}[kind + 1] || ':' || start || ':' || stop AS s FROM spans) GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (row)
"""

OP13_HARD_NEGATIVES = f"""
WITH kept AS (
    SELECT row_number() OVER () AS row, *
    FROM (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
          FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_KEPT})
), scored AS (
    SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS id, a.label = b.label AS same,
           list_dot_product(a.v, b.v)::BIGINT AS score
    FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.id)::INT AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
WHERE 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.id) <= 5
"""
