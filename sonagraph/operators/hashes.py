"""Pairing peaks into hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import HashConfig
from ..functions.expressions import pack_hash


def generate_hashes(points: DataFrame, cfg: HashConfig = HashConfig(), key: str = "song", per_frame: int | None = None) -> DataFrame:
    """(key, hash, time_offset): each point with the first ``max_targets`` points, by time and bin, of
    the following ``window`` frames.  A window frame instead of a self-join: no pairs beyond it are
    ever made, and a key is sorted once.

    ``per_frame``: points that a time frame has at most (``peak_quota`` bounds them).  The wanted ones
    then lie among as many following rows and ``max_targets`` more, however dense the window is;
    without it, all points of the window are gathered."""
    if per_frame is None:
        ahead = Window.partitionBy(key).orderBy("time_frame").rangeBetween(1, cfg.window)
        near = F.sort_array(F.collect_list(F.struct("time_frame", "freq_bin")).over(ahead))
    else:
        ahead = Window.partitionBy(key).orderBy("time_frame", "freq_bin").rowsBetween(1, per_frame + cfg.max_targets)
        near = F.collect_list(F.struct("time_frame", "freq_bin")).over(ahead)
    rows = points.select(key, "time_frame", "freq_bin", near.alias("near"))
    if per_frame is not None:
        gap = lambda t: t["time_frame"] - F.col("time_frame")
        rows = rows.withColumn("near", F.filter("near", lambda t: (gap(t) >= 1) & (gap(t) <= cfg.window)))
    pairs = rows.select(key, "time_frame", "freq_bin", F.explode(F.slice("near", 1, cfg.max_targets)).alias("t"))
    value = pack_hash(F.col("freq_bin"), F.col("t.freq_bin"), F.col("t.time_frame") - F.col("time_frame"))
    return pairs.select(key, value.alias("hash"), F.col("time_frame").alias("time_offset"))
