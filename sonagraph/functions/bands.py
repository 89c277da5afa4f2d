"""Logarithmic frequency bands: a small fixed table, built on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BandConfig


@dataclass(frozen=True)
class Band:
    band: int
    low_bin: int
    high_bin: int
    low_hz: float
    high_hz: float


def _round_away(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def log_bands(cfg: BandConfig = BandConfig()) -> list[Band]:
    """Bands whose edges grow by one factor; both edge bins belong to a band."""
    last = cfg.fft_size // 2
    edges = [cfg.low_hz * (cfg.high_hz / cfg.low_hz) ** (i / cfg.n_bands) for i in range(cfg.n_bands + 1)]
    bins = [min(max(_round_away(hz * cfg.fft_size / cfg.sample_rate), 0), last) for hz in edges]
    return [Band(i, bins[i], bins[i + 1], edges[i], edges[i + 1]) for i in range(cfg.n_bands)]


def bin_to_band(cfg: BandConfig = BandConfig()) -> list[int]:
    """Band of every bin, -1 outside; a bin shared by two bands belongs to the higher."""
    out = [-1] * (cfg.fft_size // 2 + 1)
    for b in log_bands(cfg):
        out[b.low_bin : b.high_bin + 1] = [b.band] * (b.high_bin - b.low_bin + 1)
    return out


def band_of(freq_bin: Column, cfg: BandConfig = BandConfig()) -> Column:
    """Band of a bin as an expression, -1 outside: one comparison a band, no join."""
    out = F.lit(-1)
    for b in log_bands(cfg):
        out = F.when(freq_bin.between(b.low_bin, b.high_bin), b.band).otherwise(out)
    return out
