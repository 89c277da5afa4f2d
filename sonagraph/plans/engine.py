"""The verbs: index recordings into a library, identify clips against it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.expressions import base_name
from ..operators.hashes import generate_hashes
from ..operators.library import DUPLICATE, Library, register_songs
from ..operators.match import best_match
from ..sources.recordings import analyse_files


class Engine:
    def __init__(self, library: Library, cfg: EngineConfig | None = None):
        self.library, self.cfg = library, cfg or EngineConfig()

    def _points(self, analyses: DataFrame, key: Column, name: str) -> DataFrame:
        return analyses.where("error IS NULL").select(key.alias(name), F.explode("peaks").alias("p")).select(name, "p.time_frame", "p.freq_bin")

    def _per_frame(self) -> int:
        """Peaks that a frame has at most."""
        return self.cfg.peaks.peaks_per_band * self.cfg.bands.n_bands

    def index(self, files: DataFrame, name: Column | None = None) -> DataFrame:
        """Add files (path, content) to the library, named by ``name`` or else their file names.

        Returns (path, song_id, name, peaks, hashes, error): known names and unreadable files have an
        error and change nothing; of equal names in one call the first path counts.  The returned report is
        persisted and may be unpersisted."""
        named = files.select("path", "content", (base_name(F.col("path")) if name is None else name).alias("name"))
        analyses = analyse_files(named, self.cfg).persist(StorageLevel.MEMORY_AND_DISK)
        good = analyses.where("error IS NULL").groupBy("name").agg(F.min("path").alias("path"))
        last = self.library.last_id()
        fresh = register_songs(good, self.library.songs(), last).join(good, "name").persist(StorageLevel.MEMORY_AND_DISK)
        n = fresh.count()
        chosen = analyses.join(fresh.select("path", "id"), "path")
        hashes = generate_hashes(self._points(chosen, F.col("id"), "song"), self.cfg.hashes, per_frame=self._per_frame())
        self.library.add_fingerprints(hashes.select("hash", F.col("song").alias("song_id"), "time_offset"))
        self.library.add_songs(fresh.select("id", "name"))
        fresh.unpersist()
        # the report reads what is stored now: the songs and postings of this call's ids
        added = self.library.songs().where(F.col("id").between(last + 1, last + n)).select(F.col("id").alias("song_id"), "name")
        stored = self.library.fingerprints().where(F.col("song_id").between(last + 1, last + n))
        counts = stored.groupBy("song_id").agg(F.count(F.lit(1)).alias("hashes"))
        added = added.join(good, "name").join(counts, "song_id", "left").select("path", "song_id", "hashes")
        out = analyses.join(added, "path", "left")
        error = F.coalesce("error", F.when(F.col("song_id").isNull(), DUPLICATE))
        found = F.when(error.isNull(), F.size("peaks"))
        # the report is a row a file; once it is there, the peaks of all files can go
        report = out.select("path", "song_id", "name", found.alias("peaks"), F.when(error.isNull(), F.coalesce("hashes", F.lit(0))).cast("int").alias("hashes"), error.alias("error"))
        report = report.persist(StorageLevel.MEMORY_AND_DISK)
        report.count()
        analyses.unpersist()
        return report

    def query(self, files: DataFrame) -> DataFrame:
        """(path, song_id, name, votes, confidence, alignment_frames, error) of clips (path, content),
        nulls where nothing matches."""
        analyses = analyse_files(files, self.cfg)
        hashes = generate_hashes(self._points(analyses, F.col("path"), "query"), self.cfg.hashes, "query", self._per_frame())
        won = best_match(hashes, self.library.fingerprints(), self.library.songs(), self.cfg.match)
        return analyses.select("path", "error").join(won, F.col("path") == F.col("query"), "left").select("path", "song_id", "name", "votes", "confidence", F.col("alignment").alias("alignment_frames"), "error")

    def stats(self) -> DataFrame:
        return self.library.stats()


def envelope(ok: Column, data: Column | None = None, error: Column | None = None) -> Column:
    """JSON of {ok, data, error}; absent parts are left out."""
    parts = [ok.alias("ok")]
    parts += [data.alias("data")] if data is not None else []
    parts += [error.alias("error")] if error is not None else []
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "true"})
