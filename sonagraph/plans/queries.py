"""Driver queries of the acoustic operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import StftConfig
from ..functions import expressions as E
from ..functions.bands import band_of, log_bands
from ..operators import frames as O
from ..operators.hashes import generate_hashes
from ..operators.library import number_names, store_stats
from ..operators.match import best_match, lookup, votes
from . import adapters as A
from .sql import ORACLES

SHORT = StftConfig(fft_size=64, hop_size=32)


def _r(x, name: str):
    return F.round(x, 6).alias(name)


def hann_window(spark, sf_dir):
    ids = A.table(spark, sf_dir, "embeddings").select("vec_id")
    return ids.where("vec_id < 64").select("vec_id", _r(E.hann_weight(F.col("vec_id"), F.lit(64)), "weight"))


def stft_frames(spark, sf_dir):
    rows = O.stft_frames(A.signal(spark, sf_dir), SHORT)
    return rows.select("song", "time_frame", "i", _r(F.col("x"), "x"))


def dft_magnitude(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("song"), F.col("vec_id").cast("int").alias("time_frame"), F.posexplode("embedding").alias("i", "v"))
    frames = rows.select("song", "time_frame", "i", (F.col("v").cast("double") * E.hann_weight(F.col("i"), F.lit(64))).alias("x"))
    out = O.dft(frames, 64)
    return out.select("time_frame", "freq_bin", _r(O.magnitude(F.col("re"), F.col("im")), "magnitude"))


def magnitude_db(spark, sf_dir):
    return O.with_db(A.library_frames(spark, sf_dir)).select("song", "time_frame", "freq_bin", _r(F.col("db"), "db"))


def frame_median(spark, sf_dir):
    out = O.frame_median(O.with_db(A.library_frames(spark, sf_dir)))
    return out.select("song", "time_frame", _r(F.col("floor_db"), "floor_db"))


def log_bands_query(spark, sf_dir):
    rows = [(b.band, b.low_bin, b.high_bin, round(b.low_hz, 6), round(b.high_hz, 6)) for b in log_bands(A.BANDS)]
    return spark.createDataFrame(rows, "band int, low_bin int, high_bin int, low_hz double, high_hz double")


def bin_bands(spark, sf_dir):
    frames = A.library_frames(spark, sf_dir).select("freq_bin").distinct()
    return frames.select("freq_bin", band_of(F.col("freq_bin"), A.BANDS).alias("band"))


def local_maxima(spark, sf_dir):
    rows = O.local_maxima(O.with_db(A.library_frames(spark, sf_dir)))
    return rows.select("song", "time_frame", "freq_bin", _r(F.col("db"), "db"))


def extract_peaks(spark, sf_dir):
    rows = A.peaks_of(A.library_frames(spark, sf_dir))
    return rows.select("song", "time_frame", "freq_bin", _r(F.col("magnitude_db"), "magnitude_db"))


def peak_quota(spark, sf_dir):
    rows = O.with_db(A.library_frames(spark, sf_dir)).withColumn("band", band_of(F.col("freq_bin"), A.BANDS)).where("band >= 0")
    return O.peak_quota(rows, 2).select("song", "time_frame", "band", "freq_bin")


def band_distribution(spark, sf_dir):
    return O.band_distribution(A.peaks_of(A.library_frames(spark, sf_dir)), band_of(F.col("freq_bin"), A.BANDS))


def time_span(spark, sf_dir):
    return O.time_span(A.peaks_of(A.library_frames(spark, sf_dir)))


def points_in_range(spark, sf_dir):
    return O.points_in_time_range(O.constellation(A.peaks_of(A.library_frames(spark, sf_dir))), 10, 20)


def constellation_sorted(spark, sf_dir):
    return O.sorted_by_time(O.constellation(A.peaks_of(A.library_frames(spark, sf_dir))))


def _packed(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem")
    delta = F.col("l_linenumber") * 1000 - 2500
    return rows.select("l_orderkey", "l_linenumber", E.pack_hash(F.col("l_partkey"), F.col("l_suppkey"), delta).alias("hash"))


def pack_hash(spark, sf_dir):
    return _packed(spark, sf_dir)


def unpack_hash(spark, sf_dir):
    return _packed(spark, sf_dir).select("l_orderkey", "l_linenumber", E.unpack_hash(F.col("hash")).alias("p")).select("l_orderkey", "l_linenumber", "p.anchor_bin", "p.target_bin", "p.delta")


def hash_string(spark, sf_dir):
    return _packed(spark, sf_dir).select("l_orderkey", "l_linenumber", E.hash_string(F.col("hash"), F.col("l_linenumber")).alias("text"))


def fan_out_hashes(spark, sf_dir):
    return A.hashes_of(A.library_frames(spark, sf_dir))


def hash_lookup(spark, sf_dir):
    """Postings of the packed line items under one hash."""
    rows = _packed(spark, sf_dir).select("hash", F.col("l_orderkey").alias("song_id"), F.col("l_linenumber").alias("time_offset"))
    return lookup(rows, (1023 << 22) | (5 << 12))


def store_stats_query(spark, sf_dir):
    rows = _packed(spark, sf_dir)
    songs = rows.select("l_orderkey").distinct()
    return store_stats(songs, rows)


def stats_string(spark, sf_dir):
    out = store_stats(A.songs(spark, sf_dir), A.fingerprints(spark, sf_dir))
    return out.select(E.stats_string(F.col("songs"), F.col("hash_entries"), F.col("total_postings")).alias("text"))


def register_songs(spark, sf_dir):
    """Names with duplicates: the customers' names without their last two digits; those of part 0 are
    registered already."""
    rows = A.table(spark, sf_dir, "customer")
    name = F.expr("substring(c_name, 1, length(c_name) - 2)")
    names = rows.select(name.alias("name")).distinct()
    known = rows.where("c_custkey < 100").select(name.alias("name")).distinct()
    return number_names(names.join(known, "name", "left_anti"), 7)


def song_lookup(spark, sf_dir):
    """The name of each posting's song; unknown ones are empty."""
    rows = A.fingerprints(spark, sf_dir).groupBy("song_id").agg(F.count(F.lit(1)).alias("postings"))
    songs = A.songs(spark, sf_dir).where("id % 2 = 0").withColumnRenamed("id", "song_id")
    return rows.join(songs, "song_id", "left").select("song_id", "postings", F.coalesce("name", F.lit("")).alias("name"))


def match_votes(spark, sf_dir):
    return votes(A.clip_hashes(spark, sf_dir), A.fingerprints(spark, sf_dir))


def best_match_query(spark, sf_dir):
    """Every song of the library, from its 25th frame on, as a query against the whole library."""
    points = O.constellation(A.peaks_of(A.library_frames(spark, sf_dir))).where("time_frame >= 25")
    points = points.select(F.col("song").alias("query"), (F.col("time_frame") - 25).alias("time_frame"), "freq_bin")
    out = best_match(generate_hashes(points, key="query", per_frame=A.PER_FRAME), A.fingerprints(spark, sf_dir), A.songs(spark, sf_dir))
    return out.withColumn("confidence", F.round("confidence", 6))


def index_then_query(spark, sf_dir):
    out = best_match(A.clip_hashes(spark, sf_dir), A.fingerprints(spark, sf_dir), A.songs(spark, sf_dir))
    return out.select("song_id", "name", "votes", "total_hits", _r(F.col("confidence"), "confidence"), F.col("alignment").alias("alignment_frames"))


def pcm_quantize(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events")
    x = (F.col("value") - 250) / 200
    return rows.select("event_id", E.quantize16(x).alias("sample"), _r(E.from_int16(E.quantize16(x)), "x"))


def pcm_downmix(spark, sf_dir):
    """Each user's whole values as interleaved 16-bit stereo."""
    rows = A.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", F.floor("value").cast("int").alias("v")))).alias("s"))
    mono = E.from_int16_stereo(F.transform("s", lambda s: s["v"]))
    return rows.select("user_id", F.posexplode(mono).alias("n", "x")).select("user_id", F.col("n").cast("long").alias("n"), _r(F.col("x"), "x"))


def wav_roundtrip(spark, sf_dir):
    """Each user's values through WAV bytes and back."""
    from ..sources.recordings import decode_files, encode_signals

    rows = A.signal(spark, sf_dir).groupBy("song").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("s"))
    signals = rows.select(F.col("song").cast("string").alias("path"), F.lit(8000).alias("sample_rate"), F.transform("s", lambda s: s["x"]).alias("samples"))
    out = decode_files(encode_signals(signals))
    return out.select(F.col("path").alias("song"), "sample_rate", F.posexplode("samples").alias("n", "x")).select("song", "sample_rate", F.col("n").cast("long").alias("n"), _r(F.col("x"), "x"))


def frame_time(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events")
    rate = F.expr("CASE WHEN user_id % 10 = 0 THEN 0 ELSE 44100 END")
    return rows.select("event_id", _r(E.time_of_frame(F.col("event_id"), F.lit(2048), rate), "seconds"))


def bin_frequency(spark, sf_dir):
    rows = A.library_frames(spark, sf_dir).select("freq_bin").distinct()
    return rows.select("freq_bin", _r(E.frequency_of_bin(F.col("freq_bin"), F.lit(44100), F.lit(4096)), "hz"), E.num_bins(F.lit(4096)).alias("bins"))


def signal_duration(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"))
    return rows.select("user_id", "samples", _r(E.duration(F.col("samples"), F.expr("CASE WHEN user_id % 10 = 0 THEN 0 ELSE 8000 END")), "seconds"))


def power_of_two(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", E.next_power_of_two(F.col("o_orderkey") - 5).alias("p"))


def song_name_from_path(spark, sf_dir):
    rows = A.table(spark, sf_dir, "pages")
    given = F.expr("CASE WHEN page_id % 3 = 0 THEN concat('  page ', page_id, ' ') END")
    return rows.select("page_id", E.song_name(given, F.col("url")).alias("name"))


def json_envelope(spark, sf_dir):
    from .engine import envelope

    rows = A.table(spark, sf_dir, "region")
    data = F.when(F.col("r_regionkey") > 0, F.struct("r_regionkey", "r_name"))
    error = F.when(F.col("r_regionkey") == 0, F.lit("no match found"))
    return rows.select("r_regionkey", envelope(F.col("r_regionkey") > 0, data, error).alias("body"))


_RENAMED = {"log_bands_query": "log_bands", "store_stats_query": "store_stats", "best_match_query": "best_match"}
_ALL = (
    hann_window, stft_frames, dft_magnitude, magnitude_db, frame_median, log_bands_query, bin_bands, local_maxima, extract_peaks, peak_quota, band_distribution, time_span, points_in_range, constellation_sorted,
    pack_hash, unpack_hash, hash_string, fan_out_hashes, hash_lookup, store_stats_query, stats_string, register_songs, song_lookup, match_votes, best_match_query, index_then_query,
    pcm_quantize, pcm_downmix, wav_roundtrip, frame_time, bin_frequency, signal_duration, power_of_two, song_name_from_path, json_envelope,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {_RENAMED.get(f.__name__, f.__name__): f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
