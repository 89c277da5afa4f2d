"""DuckDB SQL of the text operators that SQL can express, each written its own way."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
win AS (
  SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM hit) GROUP BY r),
ln AS (
  SELECT r, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
),
m AS (
  SELECT doc_id, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
    length(text) - length(replace(text, '!', '')) AS exclamations,
    length(text) - length(replace(text, chr(10), '')) + 1 AS lines
  FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_symbols >= n_words
    OR 10 * n_dup_lines > 3 * lines OR 2 * capitals > word_chars OR 2 * exclamations > n_words) AS kept
FROM f
"""

MIXING = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(source, 'null')), 1, 15))::BIGINT AS place
  FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
),
-- each round fixes the sources that would get more than three times their size
fill AS (
  SELECT 0 AS round, source, source_size, weight, false AS capped FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight,
    capped OR 3.0 * source_size <= weight * (total - spent) / free
  FROM (
    SELECT *, sum(source_size) OVER () AS total,
      coalesce(sum(CASE WHEN capped THEN 3.0 * source_size END) OVER (), 0)::DOUBLE AS spent,
      sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS free
    FROM fill
  ) WHERE round < 60 AND free > 0
),
last_round AS (SELECT * FROM fill WHERE round = (SELECT max(round) FROM fill)),
t AS (
  SELECT source, source_size,
    CASE WHEN capped THEN 3.0 * source_size::DOUBLE
      ELSE weight * (sum(source_size) OVER ()::DOUBLE - coalesce(sum(CASE WHEN capped THEN 3.0 * source_size END) OVER (), 0)::DOUBLE)
        / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
  FROM last_round
),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
),
b AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS part,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(size) OVER (PARTITION BY d.source, place) AS here, count(*) OVER (PARTITION BY d.source, place) AS n
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (whole * size + CASE WHEN before + here <= part THEN size WHEN before > part THEN 0
    WHEN n = 1 THEN CASE WHEN 2 * (part - before) >= here THEN size ELSE 0 END
    ELSE floor(size * (part - before) / here) END)::BIGINT AS taken
FROM b
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS x FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
w AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
t AS (
  SELECT a.r, a.doc_id, a.i AS i1, b.i AS i2, c.i AS i3, a.x AS x1, b.x AS x2, c.x AS x3
  FROM w a JOIN w b ON a.r = b.r AND b.k = a.k + 1 JOIN w c ON a.r = c.r AND c.k = a.k + 2
),
later AS (
  SELECT * FROM (SELECT *, first_value({'d': doc_id, 'i': i1}) OVER (PARTITION BY x1, x2, x3 ORDER BY doc_id NULLS FIRST, i1) AS f FROM t)
  WHERE f.d IS DISTINCT FROM doc_id OR f.i <> i1
),
gone AS (SELECT DISTINCT r, unnest([i1, i2, i3]) AS i FROM later),
kept AS (
  SELECT l.r, string_agg(x, chr(10) ORDER BY i) AS body, count(*) AS n
  FROM l ANTI JOIN gone ON l.r = gone.r AND l.i = gone.i GROUP BY l.r
),
n AS (SELECT r, count(*) AS n_lines FROM w GROUP BY r),
g AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  md5(coalesce(body, '')) AS kept_md5
FROM d LEFT JOIN n USING (r) LEFT JOIN g USING (r) LEFT JOIN kept USING (r)
"""

_KINDS = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["''']?\x20*[:=]\x20*["''']?([A-Za-z0-9+/_.=-]+)""".replace("'''", "''"), 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "google": (r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    "bearer": (r"[bB]earer [A-Za-z0-9._~+/-]{20,}=*", 0, 0),
}
_SPANS = " UNION ALL ".join(
    f"SELECT r, {i} AS rank, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {g})) AS v, {least} AS least, unnest(string_split_regex(text, '{p}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS k FROM d"
    for i, (kind, (p, g, least)) in enumerate(_KINDS.items())
)
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({_SPANS}),
ends AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, rank ORDER BY k) AS e FROM raw),
found AS (SELECT r, rank, kind, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM ends WHERE length(v) >= least),
agg AS (
  SELECT r, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS c, count(*) FILTER (rank = 2) AS h,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank <= 2) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM found GROUP BY r
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (r)
"""

ORACLES = {
    "op2_quality_rules": QUALITY,
    "op3_secret_scan": SECRETS,
    "op7_source_mixing": MIXING,
    "op10_line_dedup": LINES,
}
