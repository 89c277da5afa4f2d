"""WAV bytes, transforms, peaks and hashes on synthesized signals."""

import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagraph.config import BandConfig, EngineConfig, HashConfig, PeakConfig, StftConfig
from sonagraph.functions import dsp, wav
from sonagraph.functions import expressions as E
from sonagraph.functions.bands import bin_to_band, log_bands
from sonagraph.operators import frames as O
from sonagraph.operators.hashes import generate_hashes

RATE = 44100
A_MAJOR = (440, 554.37, 659.25, 880)


def chord(freqs, seconds, rate=RATE):
    n = np.arange(int(rate * seconds))
    return sum(np.sin(2 * np.pi * f * n / rate) for f in freqs) / len(freqs)


def through_wav(x):
    return wav.decode(wav.encode(x, RATE))[1]


def all_peaks(x, chunk=dsp.CHUNK_FRAMES):
    cfg = EngineConfig()
    parts = list(dsp.peaks(x, cfg.stft, cfg.peaks, cfg.bands, chunk))
    return [(int(t), int(f)) for ts, fs, _ in parts for t, f in zip(ts, fs, strict=True)]


def wav_bytes(body=b"", bits=16, channels=1, code=1, before=b"", fmt=True, data=True):
    out = before
    if fmt:
        out += b"fmt " + struct.pack("<IHHIIHH", 16, code, channels, RATE, RATE * channels * bits // 8, channels * bits // 8, bits)
    if data:
        out += b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(out)) + b"WAVE" + out


@pytest.mark.parametrize("rate", [8000, 22050, 44100, 48000])
def test_wav_round_trip(rate):
    x = chord((440,), 0.5, rate)
    data = wav.encode(x, rate)
    got_rate, y = wav.decode(data)
    assert len(data) == 44 + 2 * len(x) and got_rate == rate
    assert np.abs(x - y).max() <= 1.5 / 32767


def test_wav_clips():
    assert np.allclose(wav.decode(wav.encode(np.array([2.0, -3.0, 1.5, -1.5]), RATE))[1], [1, -1, 1, -1])


@pytest.mark.parametrize(
    ("data", "message"),
    [
        (b"", wav.NOT_WAV),
        (b"this is not a WAV file at all", wav.NOT_WAV),
        (wav_bytes(fmt=False, body=b"\0\0"), wav.NO_FORMAT),
        (wav_bytes(data=False), wav.NO_DATA),
        (wav_bytes(b"\0\0", code=3), wav.UNSUPPORTED_FORMAT),
        (wav_bytes(b"\0\0\0", bits=24), wav.UNSUPPORTED_DEPTH),
        (wav_bytes(b"", bits=24), wav.EMPTY_AUDIO),
        (wav_bytes(b"\0\0")[:-1], "truncated data chunk"),
    ],
)
def test_wav_errors(data, message):
    with pytest.raises(wav.WavError, match=re.escape(message)):
        wav.decode(data)
    assert wav.is_wav_error(message) == (not message.startswith("truncated"))


def test_wav_depths_channels_and_chunks():
    assert np.allclose(wav.decode(wav_bytes(bytes([0, 128, 255]), bits=8))[1], [-1, 0, 127 / 128])
    assert np.allclose(wav.decode(wav_bytes(struct.pack("<i", 2**31 - 1), bits=32))[1], [1])
    assert np.allclose(wav.decode(wav_bytes(struct.pack("<6h", 0, 32767, 0, 100, 200, 300), channels=3))[1], [1 / 3, 200 / 32767])
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    assert len(wav.decode(wav_bytes(b"\1\0", before=odd))[1]) == 1


def test_fft():
    n = np.arange(8)
    m = dsp.magnitude_spectrum(dsp.fft(np.sin(2 * np.pi * n / 8)))
    assert m.argmax() == 1 and len(m) == 5
    assert np.allclose(dsp.magnitude_spectrum(dsp.fft(np.ones(16))), [16] + [0] * 8)
    for bad in (np.zeros(0), np.zeros(6)):
        with pytest.raises(ValueError):
            dsp.fft(bad)


def test_frames():
    cfg = StftConfig()
    assert dsp.n_frames(8192, cfg) == 3 and dsp.n_frames(4095, cfg) == 0
    m = dsp.magnitudes(chord((1000,), 1), cfg)
    assert abs(int(m[3].argmax()) - round(1000 * 4096 / RATE)) <= 2
    for bad in ({"fft_size": 1000}, {"hop_size": 0}):
        with pytest.raises(ValueError):
            StftConfig(**bad)


def test_bands():
    table = bin_to_band()
    assert [table.index(b) for b in range(6)] == [19, 36, 68, 131, 252, 484]
    assert table[0] == -1 and table[929] == 5 and table[930] == -1
    assert [b.low_bin for b in log_bands(BandConfig(6, 2, 60, 128, 128))] == [2, 4, 6, 11, 19, 34]


@pytest.mark.parametrize(("seconds", "freqs", "n"), [(7, A_MAJOR, 206), (6, A_MAJOR, 179), (6, (293.66, 369.99, 440, 587.33), 170)])
def test_known_peak_counts(seconds, freqs, n):
    assert len(all_peaks(through_wav(chord(freqs, seconds)))) == n


def test_silence_and_chunks():
    assert all_peaks(through_wav(np.zeros(RATE))) == []
    x = through_wav(chord(A_MAJOR, 4))
    assert all_peaks(x) == all_peaks(x, chunk=7)


def test_window_path_equals_array_path(spark):
    x = through_wav(chord(A_MAJOR, 1.5) * np.linspace(0.2, 1, int(RATE * 1.5)))
    m = dsp.magnitudes(x, StftConfig())[:, :1000]
    rows = [(1, t, f, float(m[t, f])) for t in range(m.shape[0]) for f in range(m.shape[1])]
    df = spark.createDataFrame(rows, "song long, time_frame int, freq_bin int, magnitude double")
    got = {(r["time_frame"], r["freq_bin"]) for r in O.extract_peaks(df).collect()}
    db = dsp.to_db(m)
    keep = (db >= np.median(db, axis=1, keepdims=True) + 10) & dsp.local_maxima(db, 2, 5)
    assert got and got <= {(int(t), int(f)) for t, f in zip(*np.nonzero(keep), strict=True)}
    full = dsp.magnitudes(x, StftConfig())
    assert full.shape[1] == 2049


def test_ties_kill_both(spark):
    db = np.zeros((5, 11))
    db[2, 3] = db[2, 7] = 1
    assert not dsp.local_maxima(db, 2, 5).any()
    db[2, 7] = 2
    assert list(zip(*map(list, np.nonzero(dsp.local_maxima(db, 2, 5))), strict=True)) == [(2, 7)]
    rows = [(1, t, f, float(db[t, f])) for t in range(5) for f in range(11)]
    got = O.local_maxima(spark.createDataFrame(rows, "song long, time_frame int, freq_bin int, db double"), PeakConfig()).collect()
    assert [(r["time_frame"], r["freq_bin"]) for r in got] == [(2, 7)]


POINTS = [(t * t % 37, 30 + 53 * t % 301) for t in range(12)]


def brute_hashes(points, window, k):
    out = []
    for t, f in points:
        for u, g in sorted(p for p in points if 0 < p[0] - t <= window)[:k]:
            out.append(((f << 22) | (g << 12) | (u - t), t))
    return sorted(out)


@pytest.mark.parametrize(("window", "k"), [(100, 5), (20, 2), (3, 1)])
def test_fan_out(spark, window, k):
    df = spark.createDataFrame([(1, t, f) for t, f in POINTS], "song long, time_frame int, freq_bin int")
    for per_frame in (None, 3):
        got = generate_hashes(df, HashConfig(window, k), per_frame=per_frame).collect()
        assert sorted((r["hash"], r["time_offset"]) for r in got) == brute_hashes(POINTS, window, k)


def test_expressions(spark):
    rows = spark.createDataFrame([(9999, 9999, 99999), (-1, -5, -100), (41, 92, 50), (1023, 1023, 4095)], "a int, t int, d int")
    h = rows.select(E.pack_hash(F.col("a"), F.col("t"), F.col("d")).alias("h")).select("h", E.unpack_hash(F.col("h")).alias("p"), E.hash_string(F.col("h"), F.lit(7)).alias("s")).collect()
    assert [tuple(r["p"]) for r in h] == [(1023, 1023, 4095), (0, 0, 0), (41, 92, 50), (1023, 1023, 4095)]
    assert h[0]["h"] == 0xFFFFFFFF and h[0]["s"] == "HashRecord{hash=0xFFFFFFFF anchor=1023 target=1023 delta=4095 offset=7}"
    ns = spark.createDataFrame([(x,) for x in (-3, 0, 1, 2, 3, 5, 1000, 1024)], "n long")
    assert [r[0] for r in ns.select(E.next_power_of_two(F.col("n"))).collect()] == [1, 1, 1, 2, 4, 8, 1024, 1024]
    one = spark.range(1)
    r = one.select(
        E.hann_window(5), E.duration(F.lit(10), F.lit(0)), E.quantize16(F.lit(2.5 / 32767)), E.from_int16_stereo(F.array(F.lit(32767), F.lit(0), F.lit(5))), E.from_int16_mono(F.array(F.lit(32767))),
        E.song_name(F.lit("  "), F.lit("/x/My.Song.wav")), E.song_name(F.lit(None).cast("string"), F.lit("")), E.song_name(F.lit(" n "), F.lit("x.wav")), E.apply_window(F.array(F.lit(2.0)), F.array(F.lit(0.5))),
    ).first()
    assert np.allclose(r[0], dsp.hann(5)) and r[1:3] == (0.0, 3)
    assert r[3] == [0.5] and r[4] == [1.0] and r[5:8] == ("My.Song", "unknown", "n") and r[8] == [1.0]


def test_constellation(spark):
    df = spark.createDataFrame([(1, 3, 10, -1.0), (1, 1, 20, -2.0), (1, 7, 5, -3.0)], "song long, time_frame int, freq_bin int, magnitude_db double")
    assert tuple(O.time_span(df).first()) == (1, 7)
    assert tuple(O.time_span(df.limit(0)).first()) == (0, 0)
    assert O.points_in_time_range(O.constellation(df), 2, 7).count() == 2
    assert [r["time_frame"] for r in O.sorted_by_time(df).collect()] == [1, 3, 7]
    band = F.when(F.col("freq_bin") == 5, -1).otherwise(F.floor(F.col("freq_bin") / 15).cast("int"))
    assert O.band_distribution_map(df, band).first()[0] == {0: 1, 1: 1}
