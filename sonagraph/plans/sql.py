"""DuckDB SQL of the acoustic queries, in other formulations than the Spark plans: neighbours by NOT
EXISTS, targets by a range join, frames by generated starts."""

from __future__ import annotations

_BANDS = """(VALUES (0, 2, 3), (1, 4, 5), (2, 6, 10), (3, 11, 18), (4, 19, 33), (5, 34, 60)) AS bands(band, lo, hi)"""


def _frames(name: str, song: str, frame: str, where: str = "true") -> str:
    return f"""
{name}_cells AS (
  SELECT {song} AS song, ({frame})::INT AS time_frame, (j - 1)::INT AS freq_bin,
    20 * log10(abs(embedding[j]::DOUBLE) + 1e-10) AS db, abs(embedding[j]::DOUBLE) AS magnitude
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings WHERE {where})
)"""


def _peaks(name: str) -> str:
    """Peaks of {name}_cells as {name}_peaks."""
    return f"""
{name}_floor AS (SELECT song, time_frame, median(db) AS floor_db FROM {name}_cells GROUP BY ALL),
{name}_max AS (
  SELECT * FROM {name}_cells c WHERE NOT EXISTS (
    SELECT 1 FROM {name}_cells o WHERE o.song = c.song AND o.time_frame BETWEEN c.time_frame - 2 AND c.time_frame + 2
      AND o.freq_bin BETWEEN c.freq_bin - 5 AND c.freq_bin + 5
      AND (o.time_frame <> c.time_frame OR o.freq_bin <> c.freq_bin) AND o.db >= c.db)
),
{name}_peaks AS (
  SELECT song, time_frame, freq_bin, db, band FROM (
    SELECT m.*, band, row_number() OVER (PARTITION BY m.song, m.time_frame, band ORDER BY db DESC, freq_bin) AS k
    FROM {name}_max m JOIN {name}_floor f ON m.song = f.song AND m.time_frame = f.time_frame
    JOIN {_BANDS} ON freq_bin BETWEEN lo AND hi
    WHERE db >= floor_db + 10
  ) WHERE k <= 5
)"""


def _hashes(name: str, points: str) -> str:
    return f"""
{name}_hashes AS (
  SELECT song, (a_bin << 22) | (t_bin << 12) | delta AS hash, time_offset FROM (
    SELECT a.song, a.freq_bin::BIGINT AS a_bin, t.freq_bin::BIGINT AS t_bin, (t.time_frame - a.time_frame)::BIGINT AS delta, a.time_frame AS time_offset,
      row_number() OVER (PARTITION BY a.song, a.time_frame, a.freq_bin ORDER BY t.time_frame, t.freq_bin) AS k
    FROM {points} a JOIN {points} t ON a.song = t.song AND t.time_frame > a.time_frame AND t.time_frame <= a.time_frame + 100
  ) WHERE k <= 5
)"""


_LIB = _frames("lib", "vec_id // 125", "vec_id % 125")
_CLIP = _frames("clip", "0::BIGINT", "vec_id - 290", "vec_id BETWEEN 290 AND 339")
_LIB_PEAKS = f"WITH {_LIB}, {_peaks('lib')}"
_LIB_HASHES = f"{_LIB_PEAKS}, {_hashes('lib', 'lib_peaks')}"
_BOTH = f"{_LIB_HASHES}, {_CLIP}, {_peaks('clip')}, {_hashes('clip', 'clip_peaks')}"
_VOTES = """tally AS (
  SELECT q.song AS query, p.song AS song_id, p.time_offset - q.time_offset AS alignment, count(*) AS votes
  FROM {q} q JOIN lib_hashes p ON q.hash = p.hash GROUP BY ALL
)"""
_WIN = """won AS (
  SELECT * FROM (
    SELECT *, sum(votes) OVER (PARTITION BY query)::BIGINT AS total_hits,
      row_number() OVER (PARTITION BY query ORDER BY votes DESC, song_id, alignment) AS k FROM tally
  ) WHERE k = 1 AND votes >= 5 AND votes / total_hits >= 0.01
)"""
_PACKED = """WITH packed AS (
  SELECT l_orderkey, l_linenumber,
    (least(greatest(l_partkey, 0), 1023)::BIGINT << 22) | (least(greatest(l_suppkey, 0), 1023)::BIGINT << 12)
      | least(greatest(l_linenumber * 1000 - 2500, 0), 4095)::BIGINT AS hash
  FROM lineitem
)"""
_SIGNAL = """sig AS (
  SELECT user_id AS song, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, (value - 250) / 250 AS x FROM events
)"""
_HANN = "0.5 * (1 - cos(2 * pi() * {i} / 63))"

ORACLES = {
    "hann_window": f"SELECT vec_id, round({_HANN.format(i='vec_id')}, 6) AS weight FROM embeddings WHERE vec_id < 64",
    "stft_frames": f"""WITH {_SIGNAL}, starts AS (
  SELECT song, unnest(range(0, (max(n) + 1 - 64) // 32 + 1))::INT AS time_frame FROM sig GROUP BY song HAVING max(n) + 1 >= 64
)
SELECT s.song, time_frame, (n - 32 * time_frame)::INT AS i, round(x * {_HANN.format(i='(n - 32 * time_frame)')}, 6) AS x
FROM starts s JOIN sig ON s.song = sig.song AND n BETWEEN 32 * time_frame AND 32 * time_frame + 63""",
    "dft_magnitude": f"""WITH f AS (
  SELECT vec_id::INT AS time_frame, j - 1 AS i, embedding[j]::DOUBLE * {_HANN.format(i='(j - 1)')} AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS j FROM embeddings)
)
SELECT time_frame, k::INT AS freq_bin,
  round(sqrt(pow(sum(x * cos(2 * pi() * k * i / 64)), 2) + pow(sum(x * sin(2 * pi() * k * i / 64)), 2)), 6) AS magnitude
FROM f, range(0, 33) t(k) GROUP BY time_frame, k""",
    "magnitude_db": f"WITH {_LIB} SELECT song, time_frame, freq_bin, round(db, 6) AS db FROM lib_cells",
    "frame_median": f"WITH {_LIB} SELECT song, time_frame, round(median(db), 6) AS floor_db FROM lib_cells GROUP BY ALL",
    "log_bands": """SELECT i::INT AS band, round(2 * pow(30, i / 6.0))::INT AS low_bin, round(2 * pow(30, (i + 1) / 6.0))::INT AS high_bin,
  round(2 * pow(30, i / 6.0), 6) AS low_hz, round(2 * pow(30, (i + 1) / 6.0), 6) AS high_hz FROM range(0, 6) t(i)""",
    "bin_bands": f"""SELECT freq_bin::INT AS freq_bin, coalesce(band, -1)::INT AS band
FROM (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings))) AS freq_bin) LEFT JOIN {_BANDS} ON freq_bin BETWEEN lo AND hi""",
    "local_maxima": f"{_LIB_PEAKS} SELECT song, time_frame, freq_bin, round(db, 6) AS db FROM lib_max",
    "extract_peaks": f"{_LIB_PEAKS} SELECT song, time_frame, freq_bin, round(db, 6) AS magnitude_db FROM lib_peaks",
    "peak_quota": f"""WITH {_LIB} SELECT song, time_frame, band::INT AS band, freq_bin FROM (
  SELECT c.*, band, row_number() OVER (PARTITION BY song, time_frame, band ORDER BY db DESC, freq_bin) AS k
  FROM lib_cells c JOIN {_BANDS} ON freq_bin BETWEEN lo AND hi
) WHERE k <= 2""",
    "band_distribution": f"{_LIB_PEAKS} SELECT band::INT AS band, count(*) AS points FROM lib_peaks GROUP BY band",
    "time_span": f"{_LIB_PEAKS} SELECT coalesce(min(time_frame), 0)::INT AS first_frame, coalesce(max(time_frame), 0)::INT AS last_frame FROM lib_peaks",
    "points_in_range": f"{_LIB_PEAKS} SELECT song, time_frame, freq_bin FROM lib_peaks WHERE time_frame >= 10 AND time_frame <= 20",
    "constellation_sorted": f"{_LIB_PEAKS} SELECT song, time_frame, freq_bin FROM lib_peaks ORDER BY time_frame, freq_bin",
    "pack_hash": f"{_PACKED} SELECT l_orderkey, l_linenumber, hash FROM packed",
    "unpack_hash": f"{_PACKED} SELECT l_orderkey, l_linenumber, (hash // 4194304)::INT AS anchor_bin, (hash // 4096 % 1024)::INT AS target_bin, (hash % 4096)::INT AS delta FROM packed",
    "hash_string": f"""{_PACKED} SELECT l_orderkey, l_linenumber,
  printf('HashRecord{{hash=0x%08X anchor=%d target=%d delta=%d offset=%d}}', hash, hash // 4194304, hash // 4096 % 1024, hash % 4096, l_linenumber::BIGINT) AS text FROM packed""",
    "fan_out_hashes": f"{_LIB_HASHES} SELECT song, hash, time_offset FROM lib_hashes",
    "hash_lookup": f"{_PACKED} SELECT l_orderkey AS song_id, l_linenumber AS time_offset FROM packed WHERE hash = 1023::BIGINT * 4194304 + 5 * 4096",
    "store_stats": f"{_PACKED} SELECT count(DISTINCT l_orderkey) AS songs, count(DISTINCT hash) AS hash_entries, count(*) AS total_postings FROM packed",
    "stats_string": f"""{_LIB_HASHES} SELECT printf('StoreStats{{songs=%d hashEntries=%d totalPostings=%d}}',
  (SELECT count(DISTINCT vec_id // 125) FROM embeddings), (SELECT count(DISTINCT hash) FROM lib_hashes), (SELECT count(*) FROM lib_hashes)) AS text""",
    "register_songs": """WITH n AS (SELECT DISTINCT left(c_name, length(c_name) - 2) AS name FROM customer),
fresh AS (SELECT name FROM n WHERE name NOT IN (SELECT left(c_name, length(c_name) - 2) FROM customer WHERE c_custkey < 100))
SELECT row_number() OVER (ORDER BY left(md5(name), 2), name) + 7 AS id, name FROM fresh""",
    "song_lookup": f"""{_LIB_HASHES} SELECT song AS song_id, count(*) AS postings,
  CASE WHEN song % 2 = 0 THEN 'song ' || song ELSE '' END AS name FROM lib_hashes GROUP BY song""",
    "match_votes": f"{_BOTH}, {_VOTES.format(q='clip_hashes')} SELECT query, song_id, alignment, votes FROM tally",
    "best_match": f"""{_LIB_HASHES}, late AS (SELECT song, time_frame - 25 AS time_frame, freq_bin FROM lib_peaks WHERE time_frame >= 25), {_hashes('late', 'late')},
{_VOTES.format(q='late_hashes')}, {_WIN}
SELECT query, song_id, 'song ' || song_id AS name, votes, total_hits, round(votes / total_hits, 6) AS confidence, alignment FROM won""",
    "index_then_query": f"""{_BOTH}, {_VOTES.format(q='clip_hashes')}, {_WIN}
SELECT song_id, 'song ' || song_id AS name, votes, total_hits, round(votes / total_hits, 6) AS confidence, alignment AS alignment_frames FROM won""",
    "pcm_quantize": """WITH q AS (SELECT event_id, round(CASE WHEN value > 450 THEN 1.0 WHEN value < 50 THEN -1.0 ELSE (value - 250) / 200 END * 32767)::INT AS sample FROM events)
SELECT event_id, sample, round(sample / 32767.0::DOUBLE, 6) AS x FROM q""",
    "pcm_downmix": """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, floor(value) AS v FROM events)
SELECT user_id, n // 2 AS n, round(sum(v) / 2 / 32767.0::DOUBLE, 6) AS x FROM s GROUP BY user_id, n // 2 HAVING count(*) = 2""",
    "wav_roundtrip": f"""WITH {_SIGNAL}
SELECT song::VARCHAR AS song, 8000 AS sample_rate, n, round(round(greatest(least(x, 1), -1) * 32767) / 32767, 6) AS x FROM sig""",
    "frame_time": "SELECT event_id, round(CASE WHEN user_id % 10 = 0 THEN 0 ELSE event_id * 2048 / 44100 END, 6)::DOUBLE AS seconds FROM events",
    "bin_frequency": "SELECT b::INT AS freq_bin, round(b * 44100 / 4096, 6)::DOUBLE AS hz, 2049 AS bins FROM (SELECT DISTINCT unnest(range(0, len(embedding))) AS b FROM embeddings)",
    "signal_duration": "SELECT user_id, count(*) AS samples, round(CASE WHEN user_id % 10 = 0 THEN 0 ELSE count(*) / 8000 END, 6)::DOUBLE AS seconds FROM events GROUP BY user_id",
    "power_of_two": "SELECT o_orderkey, (SELECT min(1::BIGINT << k::INT) FROM range(0, 62) t(k) WHERE (1::BIGINT << k::INT) >= o_orderkey - 5) AS p FROM orders",
    "song_name_from_path": r"""WITH b AS (SELECT page_id, list_last(string_split(url, '/')) AS f FROM pages),
c AS (SELECT page_id, CASE WHEN contains(f, '.') THEN left(f, length(f) - strpos(reverse(f), '.')) ELSE f END AS f FROM b)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'page ' || page_id WHEN f = '' THEN 'unknown' ELSE f END AS name FROM c""",
    "json_envelope": """SELECT r_regionkey, CASE WHEN r_regionkey > 0
  THEN '{"ok":true,"data":{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}}'
  ELSE '{"ok":false,"error":"no match found"}' END AS body FROM region""",
}
