"""The library, matching, and the verbs end to end on synthesized recordings."""

import json
import threading
from http.client import HTTPConnection
from http.server import ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signal import A_MAJOR, RATE, chord

from sonagraph import cli
from sonagraph.config import EngineConfig
from sonagraph.functions import wav
from sonagraph.operators.library import DUPLICATE, DuplicateSong, Library, SongNotFound, zip_batch
from sonagraph.operators.match import best_match
from sonagraph.plans.engine import Engine
from sonagraph.service import MAX_BODY, Service, handler, song_name
from sonagraph.sources import recordings
from sonagraph.streaming.ingest import ingest

D_MAJOR = (293.66, 369.99, 440, 587.33)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("wav")
    (out / "a.wav").write_bytes(wav.encode(chord(A_MAJOR, 6), RATE))
    (out / "d.wav").write_bytes(wav.encode(chord(D_MAJOR, 6), RATE))
    (out / "broken.wav").write_bytes(b"nothing")
    (out / "short.wav").write_bytes(wav.encode(chord((440,), 0.05), RATE))
    return out


@pytest.mark.parametrize("stored", [False, True])
def test_library(spark, tmp_path, stored):
    path = str(tmp_path / "db")
    lib = Library.open(spark, path, 2) if stored else Library.memory(spark)
    a, b = lib.register_song("A"), lib.register_song("B")
    assert {a, b} == {1, 2}
    with pytest.raises(DuplicateSong):
        lib.register_song("A")
    lib.store_hash(0xFFFFFFFF, a, 0)
    lib.store_batch([1, 1], b, [5, 6])
    lib.store_batch([], b, [])
    lib.store_hash(9, 77, 1)  # of no registered song: not visible
    with pytest.raises(ValueError):
        zip_batch([1, 2], [1])
    if stored:
        lib = Library.open(spark, path)
    assert lib.stats_text() == "StoreStats{songs=2 hashEntries=2 totalPostings=3}"
    assert [tuple(r) for r in lib.lookup(0xFFFFFFFF).collect()] == [(a, 0)]
    assert lib.lookup(5).count() == 0
    assert lib.song_name(b) == "B" and lib.song_name(99) is None


def test_ties_and_thresholds(spark):
    q = spark.createDataFrame([("q", h, 0) for h in range(6)] + [("few", h, 0) for h in range(4)], "query string, hash long, time_offset int")
    fp = spark.createDataFrame([(h, s, at) for h in range(6) for s, at in ((2, 3), (1, 9), (1, 4))], "hash long, song_id long, time_offset int")
    got = best_match(q, fp).collect()
    assert [(r["query"], r["song_id"], r["alignment"], r["votes"], r["total_hits"]) for r in got] == [("q", 1, 4, 6, 18)]
    assert best_match(q.limit(0), fp).count() == 0


def test_index_and_query(spark, folder):
    engine = Engine(Library.memory(spark))
    files = recordings.read_files(spark, str(folder))
    rows = {r["name"]: r for r in engine.index(files).collect()}
    assert (rows["a"]["peaks"], rows["a"]["hashes"], rows["d"]["peaks"], rows["d"]["hashes"]) == (179, 878, 170, 835)
    assert rows["short"]["hashes"] == 0 and rows["short"]["song_id"] is not None
    assert rows["broken"]["error"] == wav.NOT_WAV and rows["broken"]["song_id"] is None
    again = {r["name"]: r["error"] for r in engine.index(files).collect()}
    assert again["a"] == DUPLICATE
    clip = wav.encode(chord(A_MAJOR, 3), RATE)
    clips = spark.createDataFrame([("clip", bytearray(clip)), ("bad", bytearray(b"x")), ("still", bytearray(wav.encode(np.zeros(RATE), RATE)))], "path string, content binary")
    got = {r["path"]: r for r in engine.query(clips).collect()}
    assert got["clip"]["name"] == "a" and got["clip"]["alignment_frames"] == 0 and got["clip"]["votes"] >= 300
    assert got["bad"]["error"] == wav.NOT_WAV and got["still"]["song_id"] is None


def test_published_figures(spark):
    engine = Engine(Library.memory(spark))
    song = spark.createDataFrame([("a.wav", bytearray(wav.encode(chord(A_MAJOR, 7), RATE)))], "path string, content binary")
    r = engine.index(song).first()
    assert (r["peaks"], r["hashes"]) == (206, 1011)
    clip = spark.createDataFrame([("c", bytearray(wav.encode(chord(A_MAJOR, 7)[: 3 * RATE], RATE)))], "path string, content binary")
    r = engine.query(clip).first()
    assert (r["votes"], r["alignment_frames"], round(100 * r["confidence"], 1)) == (428, 0, 19.8)


def test_wav_sink_and_spectrogram(spark, folder, tmp_path):
    signals = recordings.decode_files(recordings.read_files(spark, str(folder / "a.wav")))
    assert recordings.spectrogram(signals).count() == (6 * RATE - 4096) // 2048 + 1
    spark.dataSource.register(recordings.WavDataSource)
    out = tmp_path / "out"
    signals.select(F.lit("copy").alias("name"), "sample_rate", "samples").write.format("wav").mode("append").save(str(out))
    assert (out / "copy.wav").read_bytes() == (folder / "a.wav").read_bytes()


def test_streaming(spark, folder, tmp_path):
    engine = Engine(Library.open(spark, str(tmp_path / "db")))
    for _ in range(2):
        ingest(engine, str(folder), str(tmp_path / "cp")).awaitTermination()
    assert engine.stats().first()["songs"] == 3


def test_large_files_are_read(spark, tmp_path):
    with open(tmp_path / "long.wav", "wb") as out:
        out.truncate((50 << 20) + 1)
    assert recordings.read_files(spark, str(tmp_path)).select("path", "length").first()["length"] == (50 << 20) + 1


def test_cli(spark, folder, tmp_path, capsys):
    db = ["--db", str(tmp_path / "db")]
    assert cli.main([], spark) == 1 and cli.main(["index"], spark) == 1
    assert cli.main(["index", str(folder / "a.wav"), *db], spark) == 0
    assert cli.main(["index", str(folder / "a.wav"), *db], spark) == 1
    assert cli.main(["query", str(folder / "a.wav"), *db], spark) == 0
    assert "match: a (878 votes" in capsys.readouterr().out
    assert cli.main(["query", str(folder / "short.wav"), *db], spark) == 2
    assert cli.main(["stats", *db], spark) == 0


def form(content, name=None):
    parts = [b'--x\r\nContent-Disposition: form-data; name="file"; filename="t.wav"\r\nContent-Type: audio/wav\r\nContent-Transfer-Encoding: binary\r\n\r\n' + content + b"\r\n"]
    if name:
        parts.append(f'--x\r\nContent-Disposition: form-data; name="name"\r\n\r\n{name}\r\n'.encode())
    return "multipart/form-data; boundary=x", b"".join(parts) + b"--x--\r\n"


def test_service(spark):
    service = Service(Engine(Library.memory(spark)))
    song = wav.encode(chord(A_MAJOR, 2), RATE)
    assert service.answer("GET", "/health") == (200, {"ok": True, "data": {"status": "ok", "version": "step5"}})
    assert service.answer("POST", "/songs", *form(song, "Tune"))[1]["data"]["name"] == "Tune"
    assert service.answer("POST", "/songs", *form(song, "Tune")) == (409, {"ok": False, "error": "song 'Tune' is already indexed"})
    assert service.answer("GET", "/songs")[1]["data"]["stats"]["songs"] == 1
    assert service.answer("POST", "/query", *form(song))[1]["data"]["name"] == "Tune"
    assert service.answer("POST", "/query", *form(wav.encode(np.zeros(RATE), RATE)))[0] == 404
    assert service.answer("POST", "/songs", *form(b"garbage")) == (400, {"ok": False, "error": f"invalid audio: {wav.NOT_WAV}"})
    assert service.answer("POST", "/songs", "text/plain", b"x")[0] == 400
    assert service.answer("DELETE", "/songs")[0] == 405 and service.answer("GET", "/query")[0] == 405
    assert service.answer("GET", "/other")[0] == 404
    assert service.answer("POST", "/songs", "x", bytes(MAX_BODY + 1))[0] == 413
    assert song_name(" ", "a/My.Song.wav") == "My.Song" and song_name(None, None) == "unknown"


def test_server(spark):
    """The running server: request ids, a body above the limit, a bad length, a failing route."""
    service = Service(Engine(Library.memory(spark)))
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(service))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    numbers = []

    def ask(method, path, headers=None):
        connection = HTTPConnection("127.0.0.1", server.server_port, timeout=60)
        connection.putrequest(method, path)
        for k, v in (headers or {}).items():
            connection.putheader(k, v)
        connection.endheaders()
        answer = connection.getresponse()
        numbers.append(answer.getheader("X-Request-ID"))
        out = answer.status, json.loads(answer.read())
        connection.close()
        return out

    try:
        assert ask("GET", "/health")[0] == 200
        assert ask("POST", "/songs", {"Content-Length": str(MAX_BODY + 1)})[0] == 413
        assert ask("POST", "/songs", {"Content-Length": "many"})[0] == 400
        service.engine = None
        assert ask("GET", "/songs") == (500, {"ok": False, "error": "internal server error"})
    finally:
        server.shutdown()
        server.server_close()
    assert len(set(numbers)) == 4


def test_postings_of_a_failed_write_stay_hidden(spark, tmp_path):
    lib = Library.open(spark, str(tmp_path / "db"))
    a = lib.register_song("A")
    lib.store_hash(9, a + 1, 3)  # its song was never registered
    b = lib.register_song("B")
    assert lib.lookup(9).count() == 0 and b > a + 1
    lib.store_hash(9, b, 4)
    assert [tuple(r) for r in lib.lookup(9).collect()] == [(b, 4)]
    assert lib.require_song(b) == "B"
    with pytest.raises(SongNotFound, match="storage: song ID not found"):
        lib.require_song(99)


def test_wav_sink_refuses_a_taken_name(spark, tmp_path):
    spark.dataSource.register(recordings.WavDataSource)
    write = lambda x: spark.createDataFrame([("s", 8000, [x])], "name string, sample_rate int, samples array<double>").write.format("wav").mode("append").save(str(tmp_path))
    write(0.5)
    write(0.5)
    with pytest.raises(Exception, match="exists"):
        write(0.25)
    assert [p.name for p in tmp_path.iterdir()] == ["s.wav"]


def test_bands_for_rate():
    cfg = EngineConfig(bands_for_rate=True)
    assert EngineConfig().bands_at(8000).sample_rate == 44100 and cfg.bands_at(8000).sample_rate == 8000


def test_index_keeps_no_peaks(spark, folder):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    report = Engine(Library.memory(spark)).index(recordings.read_files(spark, str(folder / "a.wav")))
    assert report.first()["peaks"] == 179
    report.unpersist(blocking=True)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before
