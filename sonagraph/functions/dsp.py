"""Signal processing of one recording with numpy: what an executor's Python worker runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..config import BandConfig, PeakConfig, StftConfig
from .bands import bin_to_band
from .expressions import DB_EPSILON

#: Fixed value: the message of a transform of another length.
NOT_POWER_OF_TWO = "dsp: FFT input length must be a power of two"
#: Frames that are held at once; memory follows this, not the length of a recording.
CHUNK_FRAMES = 512


def hann(n: int) -> np.ndarray:
    if n == 1:
        return np.array([np.nan])
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))


def fft(samples: np.ndarray) -> np.ndarray:
    """Discrete Fourier transform of a power-of-two number of samples."""
    n = len(samples)
    if n == 0 or n & (n - 1):
        raise ValueError(NOT_POWER_OF_TWO)
    return np.fft.fft(samples)


def magnitude_spectrum(z: np.ndarray) -> np.ndarray:
    return np.abs(z[: len(z) // 2 + 1])


def n_frames(n_samples: int, cfg: StftConfig) -> int:
    return 0 if n_samples < cfg.fft_size else (n_samples - cfg.fft_size) // cfg.hop_size + 1


def magnitudes(samples: np.ndarray, cfg: StftConfig, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Magnitudes (frames x bins) of the frames start..stop; an incomplete last frame is dropped."""
    stop = n_frames(len(samples), cfg) if stop is None else stop
    if stop <= start:
        return np.zeros((0, cfg.n_bins))
    part = samples[start * cfg.hop_size : (stop - 1) * cfg.hop_size + cfg.fft_size]
    frames = np.lib.stride_tricks.sliding_window_view(part, cfg.fft_size)[:: cfg.hop_size]
    return np.abs(np.fft.rfft(frames * hann(cfg.fft_size), axis=1))


def to_db(magnitude: np.ndarray) -> np.ndarray:
    return 20 * np.log10(magnitude + DB_EPSILON)


def _shifted_max(x: np.ndarray, offsets, axis: int) -> np.ndarray:
    out = np.full_like(x, -np.inf)
    n = x.shape[axis]
    for d in offsets:
        if abs(d) >= n:
            continue
        to = [slice(None)] * 2
        source = [slice(None)] * 2
        to[axis], source[axis] = slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d))
        np.maximum(out[tuple(to)], x[tuple(source)], out=out[tuple(to)])
    return out


def local_maxima(db: np.ndarray, dt: int, df: int) -> np.ndarray:
    """Cells above every neighbour within dt frames and df bins; an equal neighbour rules both out."""
    beside = [d for d in range(-df, df + 1) if d]
    own_row = _shifted_max(db, beside, 1)
    other_rows = _shifted_max(np.maximum(own_row, db), [d for d in range(-dt, dt + 1) if d], 0)
    return db > np.maximum(own_row, other_rows)


def peaks(samples: np.ndarray, stft: StftConfig, cfg: PeakConfig, bands: BandConfig, chunk: int = CHUNK_FRAMES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(time_frame, freq_bin, magnitude_db) of the peaks by time and bin, a stretch of frames at a time.

    Threshold over the frame's median, local maximum over all bins, then the quota of each frame and
    band by level (of equal ones the lower bin)."""
    if np.isnan(samples).any():
        raise ValueError("samples hold NaN")
    total, halo = n_frames(len(samples), stft), cfg.time_neighborhood
    table = np.array(bin_to_band(bands))
    band_of = np.full(max(stft.n_bins, len(table)), -1)
    band_of[: len(table)] = table
    for at in range(0, total, chunk):
        lo, hi = max(0, at - halo), min(total, at + chunk + halo)
        db = to_db(magnitudes(samples, stft, lo, hi))
        keep = (db >= np.median(db, axis=1, keepdims=True) + cfg.min_db_above_floor) & local_maxima(db, halo, cfg.freq_neighborhood)
        keep &= band_of[: db.shape[1]] >= 0
        frame, freq = np.nonzero(keep[at - lo : min(total, at + chunk) - lo])
        level = db[frame + at - lo, freq]
        order = np.lexsort((freq, -level, band_of[freq], frame))
        group = frame[order] * (band_of.max() + 2) + band_of[freq[order]]
        first = np.ones(len(order), bool)
        first[1:] = group[1:] != group[:-1]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        chosen = np.sort(order[rank < cfg.peaks_per_band])
        yield frame[chosen] + at, freq[chosen], level[chosen]
