"""The driver's tables read as acoustic inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BandConfig, PeakConfig
from ..operators.frames import constellation, extract_peaks
from ..operators.hashes import generate_hashes

SONG_FRAMES = 125
CLIP_START, CLIP_FRAMES = 290, 50
BANDS = BandConfig(6, 2.0, 60.0, 128, 128)
PER_FRAME = PeakConfig().peaks_per_band * BANDS.n_bands


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    return rows.select("song", "time_frame", F.posexplode("embedding").alias("freq_bin", "v")).select("song", "time_frame", "freq_bin", F.abs(F.col("v").cast("double")).alias("magnitude"))


def library_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames: a song for each 125 vectors."""
    rows = table(spark, sf_dir, "embeddings")
    song = F.expr(f"vec_id div {SONG_FRAMES}").cast("long")
    return _spread(rows.select(song.alias("song"), (F.col("vec_id") % SONG_FRAMES).cast("int").alias("time_frame"), "embedding"))


def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 290 to 339 as a clip, counted from 0."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").between(CLIP_START, CLIP_START + CLIP_FRAMES - 1))
    return _spread(rows.select(F.lit(0).cast("long").alias("song"), (F.col("vec_id") - CLIP_START).cast("int").alias("time_frame"), "embedding"))


def peaks_of(frames: DataFrame) -> DataFrame:
    return extract_peaks(frames, bands=BANDS)


def hashes_of(frames: DataFrame) -> DataFrame:
    return generate_hashes(constellation(peaks_of(frames)), per_frame=PER_FRAME)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes_of(library_frames(spark, sf_dir)).select("hash", F.col("song").alias("song_id"), "time_offset")


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {SONG_FRAMES}").cast("long").alias("id")).distinct()
    return ids.select("id", F.concat(F.lit("song "), F.col("id").cast("string")).alias("name"))


def clip_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashes_of(clip_frames(spark, sf_dir))
    return rows.select(F.col("song").alias("query"), "hash", "time_offset")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one signal a user: (song, n, x), x scaled to about [-1, 1]."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return rows.select(F.col("user_id").alias("song"), n.alias("n"), ((F.col("value") - 250) / 250).alias("x"))
