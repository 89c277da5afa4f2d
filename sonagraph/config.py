"""Parameters of the acoustic operators, with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class StftConfig:
    fft_size: int = 4096
    hop_size: int = 2048

    def __post_init__(self):
        if self.fft_size < 1 or self.fft_size & (self.fft_size - 1):
            raise ValueError("fft_size must be a power of two")
        if self.hop_size < 1:
            raise ValueError("hop_size must be positive")

    @property
    def n_bins(self) -> int:
        return self.fft_size // 2 + 1


@dataclass(frozen=True)
class PeakConfig:
    time_neighborhood: int = 2
    freq_neighborhood: int = 5
    peaks_per_band: int = 5
    min_db_above_floor: float = 10.0

    def __post_init__(self):
        if min(self.time_neighborhood, self.freq_neighborhood, self.peaks_per_band) < 0:
            raise ValueError("neighborhoods and quota must not be negative")


@dataclass(frozen=True)
class HashConfig:
    window: int = 100
    max_targets: int = 5

    def __post_init__(self):
        if self.window < 1 or self.max_targets < 1:
            raise ValueError("window and max_targets must be positive")


@dataclass(frozen=True)
class MatchConfig:
    min_votes: int = 5
    min_confidence: float = 0.01


@dataclass(frozen=True)
class BandConfig:
    """The band table is laid out for one sample rate, whatever the file's."""

    n_bands: int = 6
    low_hz: float = 200.0
    high_hz: float = 10_000.0
    fft_size: int = 4096
    sample_rate: int = 44_100


@dataclass(frozen=True)
class EngineConfig:
    stft: StftConfig = field(default_factory=StftConfig)
    peaks: PeakConfig = field(default_factory=PeakConfig)
    hashes: HashConfig = field(default_factory=HashConfig)
    match: MatchConfig = field(default_factory=MatchConfig)
    bands: BandConfig = field(default_factory=BandConfig)
    #: Lay the bands out for each recording's own sample rate and transform size instead.
    bands_for_rate: bool = False

    def bands_at(self, sample_rate: int) -> BandConfig:
        return replace(self.bands, sample_rate=sample_rate, fft_size=self.stft.fft_size) if self.bands_for_rate else self.bands
