"""DuckDB SQL for the spelling variants and the importance resampling."""

from __future__ import annotations

from codeloom.llm import importance, variants

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc_of_byte(value: int) -> int:
    """CRC-32 register after one byte, by the polynomial's rule."""
    for _ in range(8):
        value = value >> 1 ^ 0xEDB88320 if value & 1 else value >> 1
    return value


CRCS = f"[{', '.join(str(crc_of_byte(x)) for x in range(256))}]"
HEX = "instr('123456789ABCDEF', substr(h, {0}, 1))"


def sums(strings: str) -> str:
    """A query of (s, crc) for the distinct strings ``s`` of a table: the CRC-32 of their UTF-8 bytes."""
    return f"""
    SELECT s, xor(list_reduce(
        [CAST(4294967295 AS BIGINT)] || list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: 16 * {HEX.format("2 * i + 1")} + {HEX.format("2 * i + 2")}),
        lambda c, b: xor(c >> 8, {CRCS}[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM (SELECT DISTINCT s, hex(encode(s)) AS h FROM {strings})"""


VARIANTS = rf"""
WITH RECURSIVE runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), counted AS (
    SELECT id || ':' || run AS s, run, count(*) AS n FROM runs WHERE length(run) >= {variants.SHORTEST} GROUP BY id, run
), sums AS ({sums("counted")}
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN crc % {variants.LOSS} = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n
        FROM counted JOIN sums USING (s)
    ) WHERE length(word) >= {variants.SHORTEST} GROUP BY word HAVING sum(n) >= {variants.LEAST_COUNT}
), shorter AS (
    SELECT word, n, gap, substr(word, 1, gap - 1) || substr(word, gap + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS gap FROM words)
), near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.gap = b.gap AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), best AS (
    SELECT w.word, w.n, count(near) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n
    FROM words w LEFT JOIN near ON near.word = w.word GROUP BY w.word, w.n
), forms AS (
    SELECT word, n, n_near, CASE WHEN near_n >= {variants.RATIO} * n THEN near END AS form, CASE WHEN near_n >= {variants.RATIO} * n THEN near_n END AS form_n FROM best
), chain AS (
    SELECT word, word AS root, form FROM forms
    UNION ALL
    SELECT chain.word, chain.form, forms.form FROM chain JOIN forms ON forms.word = chain.form
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
RESAMPLING = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), target AS (
    SELECT regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), places AS (SELECT row, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM texts),
target_places AS (SELECT unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM target),
corpus_runs AS (SELECT row, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS s FROM places WHERE a IS NOT NULL),
target_runs AS (SELECT unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS s FROM target_places WHERE a IS NOT NULL),
strings AS (SELECT s FROM corpus_runs WHERE s IS NOT NULL UNION SELECT s FROM target_runs WHERE s IS NOT NULL),
sums AS ({sums("strings")}
), in_corpus AS (
    SELECT row, crc % {importance.BUCKETS} AS bucket, count(*) AS n FROM corpus_runs JOIN sums USING (s) GROUP BY ALL
), in_target AS (
    SELECT crc % {importance.BUCKETS} AS bucket, count(*) AS t FROM target_runs JOIN sums USING (s) GROUP BY ALL
), sizes AS (
    SELECT CAST((SELECT coalesce(sum(n), 0) FROM in_corpus) + {importance.BUCKETS} AS DOUBLE) AS s_all,
        CAST((SELECT coalesce(sum(t), 0) FROM in_target) + {importance.BUCKETS} AS DOUBLE) AS t_all
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * s_all / ((s + 1) * t_all))) AS BIGINT) AS gain
    FROM (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM in_corpus GROUP BY bucket) LEFT JOIN in_target USING (bucket), sizes
), weights AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS weight FROM in_corpus JOIN gains USING (bucket) GROUP BY row),
scored AS (
    SELECT doc_id, len(w) >= {importance.LEAST_WORDS} AS can, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
        CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
            / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM texts LEFT JOIN weights USING (row)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY can ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY can) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN can AND place <= {importance.PERCENT} * n // 100 THEN place END AS rank FROM ranked
"""
