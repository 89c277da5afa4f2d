"""Looking hashes up and voting for the song and shift they agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig


def lookup(fingerprints: DataFrame, value: int) -> DataFrame:
    """Postings of one hash; the filter is pushed to the files."""
    return fingerprints.where(F.col("hash") == F.lit(value).cast("long")).select("song_id", "time_offset")


def votes(queries: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(query, song_id, alignment, votes): matching postings by time shift.

    Equal query hashes of a shift are pre-aggregated before and after the join, so frequent hashes
    (steady tones) multiply counts instead of rows; the join side is the optimizer's choice."""
    asked = queries.groupBy("query", "hash", "time_offset").agg(F.count(F.lit(1)).alias("n"))
    stored = fingerprints.select("hash", "song_id", F.col("time_offset").alias("at"))
    shift = (F.col("at") - F.col("time_offset")).alias("alignment")
    return asked.join(stored, "hash").groupBy("query", "song_id", shift).agg(F.sum("n").alias("votes"))


def best_match(queries: DataFrame, fingerprints: DataFrame, songs: DataFrame | None = None, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """For each query (query, hash, time_offset) its winner: song_id, name, votes, total_hits,
    confidence, alignment; none if the winner misses a threshold.  Ties: smaller song_id, then
    smaller alignment."""
    tally = votes(queries, fingerprints)
    order = F.struct(F.col("votes"), (-F.col("song_id")).alias("s"), (-F.col("alignment")).alias("a"))
    best = tally.groupBy("query").agg(F.max(order).alias("b"), F.sum("votes").alias("total_hits"))
    best = best.select("query", (-F.col("b.s")).alias("song_id"), F.col("b.votes").alias("votes"), "total_hits", (F.col("b.votes") / F.col("total_hits")).alias("confidence"), (-F.col("b.a")).alias("alignment"))
    best = best.where((F.col("votes") >= cfg.min_votes) & (F.col("confidence") >= cfg.min_confidence))
    if songs is None:
        return best
    named = best.join(songs.select(F.col("id").alias("song_id"), "name"), "song_id", "left").withColumn("name", F.coalesce("name", F.lit("")))
    return named.select("query", "song_id", "name", "votes", "total_hits", "confidence", "alignment")
