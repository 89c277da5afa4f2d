"""Recordings as a source and a sink: WAV files through ``binaryFile``, one row a file."""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..config import EngineConfig
from ..functions import dsp, wav

FILES = "path string, modificationTime timestamp, length long, content binary"
SIGNALS = "path string, sample_rate int, samples array<double>, error string"
ANALYSES = "path string, sample_rate int, n_samples long, n_frames int, peaks array<struct<time_frame:int,freq_bin:int,magnitude_db:double>>, error string"
_PEAK = pa.struct([("time_frame", pa.int32()), ("freq_bin", pa.int32()), ("magnitude_db", pa.float64())])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """WAV files under ``path`` (a file, a folder or a glob), of any size that ``binaryFile`` reads; it
    fails on larger ones."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _decoded(content: bytes | None):
    try:
        return (*wav.decode(content or b""), None)
    except wav.WavError as e:
        return None, None, str(e)


def _decode(batches):
    for batch in batches:
        rows = [_decoded(x) for x in batch.column("content").to_pylist()]
        columns = [batch.column("path"), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["path", "sample_rate", "samples", "error"])


def decode_files(files: DataFrame) -> DataFrame:
    """(path, sample_rate, samples, error): an unreadable file has an error and no samples."""
    return files.select("path", "content").mapInArrow(_decode, SIGNALS)


def _analyse(batches, cfg: EngineConfig):
    # a row at a time: memory holds one recording and a stretch of its frames
    for batch in batches:
        names = batch.column("name") if "name" in batch.schema.names else [None] * batch.num_rows
        for path, content, name in zip(batch.column("path"), batch.column("content"), names, strict=True):
            rate, samples, error = _decoded(content.as_py())
            n = 0 if samples is None else len(samples)
            parts = list(dsp.peaks(samples, cfg.stft, cfg.peaks, cfg.bands_at(rate))) if n else []
            t, f, db = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3))
            found = pa.StructArray.from_arrays([pa.array(t.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(db.astype(float))], fields=list(_PEAK))
            peaks = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)
            columns = [pa.array([path.as_py()]), pa.array([rate], pa.int32()), pa.array([n], pa.int64()), pa.array([dsp.n_frames(n, cfg.stft)], pa.int32()), peaks, pa.array([error], pa.string())]
            labels = ["path", "sample_rate", "n_samples", "n_frames", "peaks", "error"]
            if name is not None:
                columns, labels = [*columns, pa.array([name.as_py()], pa.string())], [*labels, "name"]
            yield pa.RecordBatch.from_arrays(columns, labels)


def analyse_files(files: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """One row a file with its peaks: decoding, transform and peak search in one Arrow pass, so only
    peaks leave the Python worker.  A column ``name`` goes through."""
    named = "name" in files.columns
    return files.select("path", "content", *["name"] * named).mapInArrow(partial(_analyse, cfg=cfg), ANALYSES + ", name string" * named)


def spectrogram(signals: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(path, time_frame, magnitude array) of decoded signals."""

    def run(batches):
        for batch in batches:
            for path, samples in zip(batch.column("path"), batch.column("samples"), strict=True):
                x = np.array(samples.values) if samples.is_valid else np.zeros(0)
                total = dsp.n_frames(len(x), cfg.stft)
                for at in range(0, total, dsp.CHUNK_FRAMES):
                    m = dsp.magnitudes(x, cfg.stft, at, min(total, at + dsp.CHUNK_FRAMES))
                    ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
                    rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(m)), pa.array(np.arange(at, at + len(m), dtype=np.int32)), rows], ["path", "time_frame", "magnitude"])

    return signals.select("path", "samples").mapInArrow(run, "path string, time_frame int, magnitude array<double>")


def encode_signals(signals: DataFrame) -> DataFrame:
    """(path, content): signals (path, sample_rate, samples) as 16-bit mono WAV bytes."""

    def run(batches):
        for batch in batches:
            rows = [wav.encode(np.array(s or [], float), r) for s, r in zip(batch.column("samples").to_pylist(), batch.column("sample_rate").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rows, pa.binary())], ["path", "content"])

    return signals.select("path", "sample_rate", "samples").mapInArrow(run, "path string, content binary")


class WavDataSource(DataSource):
    """``df.write.format("wav").mode("append").save(folder)``: rows (name, sample_rate, samples), a
    file each.  The folder must be a mounted one that all executors share.  A name that is there already
    with other content is an error; the same content is a repeated task and replaces it."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "name string, sample_rate int, samples array<double>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _WavWriter(self.options["path"])


class _WavWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")

    def write(self, iterator):
        import os

        os.makedirs(self.folder, exist_ok=True)
        for row in iterator:
            target = os.path.join(self.folder, f"{os.path.basename(row['name'])}.wav")
            data = wav.encode(np.array(row["samples"], float), row["sample_rate"])
            part = f"{target}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as out:
                out.write(data)
            try:
                os.link(part, target)  # fails if the name is taken
            except FileExistsError:
                with open(target, "rb") as there:
                    if there.read() != data:
                        raise
            finally:
                os.remove(part)
        return WriterCommitMessage()
