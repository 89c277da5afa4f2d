"""The library: songs and their postings, in Parquet tables or in memory.

``songs(id, name)`` is the commit marker: postings are written first, and readers see those of
registered songs only, so a failed write leaves nothing visible.  New ids begin beyond those of all
songs and postings, so what such a write left behind never becomes another song's.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import stats_string

SONGS = "id long, name string"
FINGERPRINTS = "hash long, song_id long, time_offset int"


# The messages of a repeated name and of an unknown id.
DUPLICATE = "storage: song name already registered"
NOT_FOUND = "storage: song ID not found"


class DuplicateSong(ValueError):
    """A song of this name is registered already."""


class SongNotFound(KeyError):
    """No song has this id."""


def _bucket(name):
    return F.substring(F.md5(name), 1, 2)


def number_names(names: DataFrame, after: int = 0) -> DataFrame:
    """(id, name) with ids after + 1, after + 2... in the order of 256 hash buckets, then name.

    Rows are numbered within buckets in parallel; only the 256 counts meet in one task."""
    rows = names.select("name", _bucket(F.col("name")).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("bucket").alias("_b"), before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("name"))
    placed = rows.withColumn("_rank", rank).join(F.broadcast(offsets), F.col("bucket") == F.col("_b"))  # 256 rows at most
    return placed.select((F.col("_rank") + F.col("before") + after).cast("long").alias("id"), "name")


def register_songs(names: DataFrame, songs: DataFrame, after: int | None = None) -> DataFrame:
    """Rows (id, name) for the names that ``songs`` lacks, with ids beyond ``after`` (else the largest of
    ``songs``); repeated names count once."""
    fresh = names.select("name").where("name IS NOT NULL").distinct().join(songs, "name", "left_anti")
    last = (songs.agg(F.max("id")).first()[0] or 0) if after is None else after
    return number_names(fresh, last)


def store_stats(songs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """One row: songs, hash_entries (distinct hashes), total_postings."""
    by_hash = fingerprints.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    both = songs.agg(F.count(F.lit(1)).alias("songs")).select("songs", zero.alias("hash_entries"), zero.alias("total_postings"))
    both = both.unionByName(by_hash.agg(F.count(F.lit(1)).alias("hash_entries"), F.coalesce(F.sum("n"), zero).alias("total_postings")).select(zero.alias("songs"), "hash_entries", "total_postings"))
    return both.agg(*[F.sum(c).alias(c) for c in ("songs", "hash_entries", "total_postings")])


def zip_batch(hashes: list[int], offsets: list[int]) -> list[tuple[int, int]]:
    if len(hashes) != len(offsets):
        raise ValueError(f"{len(hashes)} hashes but {len(offsets)} offsets")
    return list(zip(hashes, offsets, strict=True))


class Library:
    """Tables under ``path``; ``Library.memory(spark)`` keeps them in DataFrames instead."""

    def __init__(self, spark: SparkSession, path: str | None, hash_partitions: int = 8):
        self.spark, self.path, self.hash_partitions = spark, path, hash_partitions
        if path is None:
            self._songs = spark.createDataFrame([], SONGS)
            self._fingerprints = spark.createDataFrame([], FINGERPRINTS)
        else:
            for name, schema in (("songs", SONGS), ("fingerprints", FINGERPRINTS)):
                spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    @classmethod
    def memory(cls, spark: SparkSession) -> Library:
        return cls(spark, None)

    @classmethod
    def open(cls, spark: SparkSession, path: str, hash_partitions: int = 8) -> Library:
        return cls(spark, path, hash_partitions)

    def songs(self) -> DataFrame:
        return self._songs if self.path is None else self.spark.read.schema(SONGS).parquet(f"{self.path}/songs")

    def _postings(self) -> DataFrame:
        return self._fingerprints if self.path is None else self.spark.read.schema(FINGERPRINTS).parquet(f"{self.path}/fingerprints")

    def last_id(self) -> int:
        """The largest id that a song or a posting has, registered or not."""
        ids = self.songs().select("id").unionByName(self._postings().select(F.col("song_id").alias("id")))
        return ids.agg(F.max("id")).first()[0] or 0

    def fingerprints(self) -> DataFrame:
        """Postings of registered songs."""
        return self._postings().join(self.songs().select(F.col("id").alias("song_id")), "song_id", "left_semi").select("hash", "song_id", "time_offset")

    def add_songs(self, rows: DataFrame) -> None:
        if self.path is None:
            self._songs = self._songs.unionByName(rows.select("id", "name"))
        else:
            rows.select("id", "name").write.mode("append").parquet(f"{self.path}/songs")

    def add_fingerprints(self, rows: DataFrame) -> None:
        """Postings sorted by hash within hash partitions, so a lookup skips most row groups."""
        rows = rows.select(F.col("hash").cast("long"), F.col("song_id").cast("long"), F.col("time_offset").cast("int"))
        if self.path is None:
            self._fingerprints = self._fingerprints.unionByName(rows)
        else:
            dealt = rows.repartitionByRange(self.hash_partitions, "hash").sortWithinPartitions("hash")
            dealt.write.mode("append").parquet(f"{self.path}/fingerprints")

    def register_song(self, name: str) -> int:
        if self.songs().where(F.col("name") == name).limit(1).count():
            raise DuplicateSong(name)
        row = register_songs(self.spark.createDataFrame([(name,)], "name string"), self.songs(), self.last_id())
        self.add_songs(row)
        return self.songs().where(F.col("name") == name).first()["id"]

    def store_hash(self, value: int, song_id: int, time_offset: int) -> None:
        self.store_batch([value], song_id, [time_offset])

    def store_batch(self, hashes: list[int], song_id: int, offsets: list[int]) -> None:
        rows = zip_batch(hashes, offsets)
        if rows:
            self.add_fingerprints(self.spark.createDataFrame([(h, song_id, o) for h, o in rows], FINGERPRINTS))

    def lookup(self, value: int) -> DataFrame:
        return self.fingerprints().where(F.col("hash") == F.lit(value).cast("long")).select("song_id", "time_offset")

    def song_name(self, song_id: int) -> str | None:
        row = self.songs().where(F.col("id") == song_id).first()
        return row["name"] if row else None

    def require_song(self, song_id: int) -> str:
        """The name, or ``SongNotFound``."""
        name = self.song_name(song_id)
        if name is None:
            raise SongNotFound(NOT_FOUND)
        return name

    def stats(self) -> DataFrame:
        return store_stats(self.songs(), self.fingerprints())

    def stats_text(self) -> str:
        return self.stats().select(stats_string(F.col("songs"), F.col("hash_entries"), F.col("total_postings"))).first()[0]

    def close(self) -> None:
        """Nothing stays open between calls."""
