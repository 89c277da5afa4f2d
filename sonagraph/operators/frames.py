"""Relational operators on signals, frames and peaks: every step a DataFrame plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BandConfig, PeakConfig, StftConfig
from ..functions import expressions as E
from ..functions.bands import band_of


def stft_frames(signal: DataFrame, cfg: StftConfig) -> DataFrame:
    """(song, n, x) -> (song, time_frame, i, x): count windows of fft_size samples each hop_size,
    multiplied with the Hann window; an incomplete last one is dropped.

    Each sample names the frames that hold it, so nothing is joined but the songs' lengths."""
    lengths = signal.groupBy("song").agg((F.max("n") + 1).alias("length"))
    last = F.floor(F.col("n") / cfg.hop_size)
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - (cfg.fft_size - 1)) / F.lit(cfg.hop_size)))
    rows = signal.join(lengths, "song").where(F.col("length") >= cfg.fft_size)
    last = F.least(last, F.floor((F.col("length") - cfg.fft_size) / cfg.hop_size))
    rows = rows.withColumns({"first": first.cast("int"), "last": last.cast("int")}).where("first <= last")
    rows = rows.select("song", "n", "x", F.explode(F.sequence("first", "last")).alias("time_frame"))
    i = (F.col("n") - F.col("time_frame") * cfg.hop_size).cast("int")
    return rows.select("song", "time_frame", i.alias("i"), "x").withColumn("x", F.col("x") * E.hann_weight(F.col("i"), F.lit(cfg.fft_size)))


def dft(frames: DataFrame, n: int) -> DataFrame:
    """(song, time_frame, i, x) -> (song, time_frame, freq_bin, re, im): sums of cosines and sines for
    the first n/2 + 1 bins.  Partial sums are pre-aggregated; meant for short frames (the array path
    uses a fast transform)."""
    angle = 2 * F.pi() * ((F.col("i").cast("long") * F.col("freq_bin")) % n) / n
    spread = frames.withColumn("freq_bin", F.explode(F.sequence(F.lit(0), F.lit(n // 2))))
    return spread.groupBy("song", "time_frame", "freq_bin").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(-F.col("x") * F.sin(angle)).alias("im"))


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def with_db(frames: DataFrame) -> DataFrame:
    return frames.withColumn("db", E.to_db(F.col("magnitude")))


def frame_median(frames: DataFrame) -> DataFrame:
    """(song, time_frame, floor_db): the exact median of a frame's levels."""
    return frames.groupBy("song", "time_frame").agg(F.percentile("db", F.lit(0.5)).alias("floor_db"))


def local_maxima(frames: DataFrame, cfg: PeakConfig = PeakConfig()) -> DataFrame:
    """Cells (song, time_frame, freq_bin, db) above all neighbours, in two separable passes."""
    df, dt, low = cfg.freq_neighborhood, cfg.time_neighborhood, F.lit(float("-inf"))
    row = Window.partitionBy("song", "time_frame").orderBy("freq_bin")
    column = Window.partitionBy("song", "freq_bin").orderBy("time_frame")

    def top(name: str, window, a: int, b: int) -> Column:
        return F.coalesce(F.max(name).over(window.rangeBetween(a, b)), low) if a <= b else low

    wide = frames.select("*", top("db", row, -df, df).alias("_row"), F.greatest(top("db", row, -df, -1), top("db", row, 1, df)).alias("_beside"))
    tall = wide.select("*", F.greatest(top("_row", column, -dt, -1), top("_row", column, 1, dt)).alias("_above"))
    return tall.where(F.col("db") > F.greatest("_beside", "_above")).drop("_row", "_beside", "_above")


def peak_quota(peaks: DataFrame, k: int) -> DataFrame:
    """The k highest of each frame and band, of equal ones the lower bin."""
    order = Window.partitionBy("song", "time_frame", "band").orderBy(F.col("db").desc(), "freq_bin")
    return peaks.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def extract_peaks(frames: DataFrame, cfg: PeakConfig = PeakConfig(), bands: BandConfig = BandConfig()) -> DataFrame:
    """(song, time_frame, freq_bin, magnitude) -> peaks (song, time_frame, freq_bin, magnitude_db).

    The floor and the local maximum see all bins; threshold, bands and quota come after."""
    levels = with_db(frames).select("song", "time_frame", "freq_bin", "db")
    whole = Window.partitionBy("song", "time_frame")
    floored = levels.withColumn("_floor", F.percentile("db", F.lit(0.5)).over(whole))
    found = local_maxima(floored, cfg).where(F.col("db") >= F.col("_floor") + cfg.min_db_above_floor)
    found = found.withColumn("band", band_of(F.col("freq_bin"), bands)).where("band >= 0")
    return peak_quota(found, cfg.peaks_per_band).select("song", "time_frame", "freq_bin", F.col("db").alias("magnitude_db"))


def constellation(peaks: DataFrame) -> DataFrame:
    return peaks.select("song", "time_frame", "freq_bin")


def points_in_time_range(points: DataFrame, low: int, high: int) -> DataFrame:
    return points.where(F.col("time_frame").between(low, high))


def time_span(points: DataFrame) -> DataFrame:
    """One row: first and last frame, zeros for no points."""
    return points.agg(F.coalesce(F.min("time_frame"), F.lit(0)).alias("first_frame"), F.coalesce(F.max("time_frame"), F.lit(0)).alias("last_frame"))


def band_distribution(points: DataFrame, band: Column) -> DataFrame:
    return points.select(band.alias("band")).where("band >= 0").groupBy("band").agg(F.count(F.lit(1)).alias("points"))


def band_distribution_map(points: DataFrame, band: Column) -> DataFrame:
    """The same as one map; its size is the number of bands."""
    rows = band_distribution(points, band)
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("band", "points")))).alias("distribution"))


def sorted_by_time(points: DataFrame) -> DataFrame:
    return points.orderBy("time_frame", "freq_bin")
