"""Scalar functions of the engine as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DB_EPSILON = 1e-10
# The texts of a hash and of the statistics.
HASH_TEXT = "HashRecord{hash=0x%s anchor=%d target=%d delta=%d offset=%d}"
STATS_TEXT = "StoreStats{songs=%d hashEntries=%d totalPostings=%d}"
ANCHOR_BITS, TARGET_BITS, DELTA_BITS = 10, 10, 12


def _clamp(x: Column, bits: int) -> Column:
    return F.least(F.greatest(x.cast("long"), F.lit(0).cast("long")), F.lit((1 << bits) - 1).cast("long"))


def pack_hash(anchor: Column, target: Column, delta: Column) -> Column:
    """Unsigned 32-bit hash as a long; out-of-range parts are clamped."""
    high = F.shiftleft(_clamp(anchor, ANCHOR_BITS), TARGET_BITS + DELTA_BITS)
    return high.bitwiseOR(F.shiftleft(_clamp(target, TARGET_BITS), DELTA_BITS)).bitwiseOR(_clamp(delta, DELTA_BITS))


def unpack_hash(value: Column) -> Column:
    """Struct of anchor_bin, target_bin, delta."""
    value = value.cast("long")

    def part(shift: int, bits: int, name: str) -> Column:
        return F.shiftright(value, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int").alias(name)

    return F.struct(part(22, 10, "anchor_bin"), part(12, 10, "target_bin"), part(0, 12, "delta"))


def hash_string(value: Column, offset: Column) -> Column:
    parts = unpack_hash(value)
    return F.format_string(HASH_TEXT, F.lpad(F.hex(value), 8, "0"), parts["anchor_bin"], parts["target_bin"], parts["delta"], offset)


def stats_string(songs: Column, entries: Column, postings: Column) -> Column:
    return F.format_string(STATS_TEXT, songs, entries, postings)


def hann_weight(i: Column, n: Column) -> Column:
    """Symmetric Hann window (divisor n - 1); not a number for n = 1."""
    return 0.5 * (1 - F.cos(2 * F.pi() * i / F.when(n == 1, F.lit(float("nan"))).otherwise((n - 1).cast("double"))))


def hann_window(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: hann_weight(i, F.lit(n)))


def apply_window(samples: Column, window: Column) -> Column:
    """Element-wise product of equally long arrays; an error for others."""
    product = F.zip_with(samples, window, lambda x, w: x * w)
    return F.when(F.size(samples) == F.size(window), product).otherwise(F.raise_error(F.lit("samples and window differ in length")))


def to_db(magnitude: Column) -> Column:
    return 20 * F.log10(magnitude + F.lit(DB_EPSILON))


def next_power_of_two(n: Column) -> Column:
    """1 for n <= 1; exact for longs, by the length of the binary form of n - 1."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n.cast("long") - 1))).cast("long"))


def _ratio(x: Column, y: Column) -> Column:
    return F.when(y == 0, F.lit(0.0)).otherwise(x.cast("double") / F.when(y == 0, F.lit(1)).otherwise(y))


def duration(n_samples: Column, sample_rate: Column) -> Column:
    return _ratio(n_samples, sample_rate)


def time_of_frame(frame: Column, hop_size: Column, sample_rate: Column) -> Column:
    return _ratio(frame.cast("long") * hop_size, sample_rate)


def frequency_of_bin(bin_: Column, sample_rate: Column, fft_size: Column) -> Column:
    return _ratio(bin_.cast("long") * sample_rate, fft_size)


def num_bins(fft_size: Column) -> Column:
    return (F.floor(fft_size / 2) + 1).cast("int")


def band_width(low_bin: Column, high_bin: Column) -> Column:
    return high_bin - low_bin + 1


def quantize16(x: Column) -> Column:
    """Clip to [-1, 1] and round half away from zero to 16 bits."""
    return F.round(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int")


def from_int16(x: Column) -> Column:
    return x / F.lit(32767.0)


def from_int16_mono(samples: Column) -> Column:
    """Array of 16-bit values as samples; an error for an empty one."""
    return F.when(F.size(samples) > 0, F.transform(samples, lambda x: x / F.lit(32767.0))).otherwise(F.raise_error(F.lit("empty audio")))


def from_int16_stereo(samples: Column) -> Column:
    """Interleaved left and right as the mean of each pair; an odd last value is dropped."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(samples) / 2) - 1, F.lit(0)).cast("int")), lambda i: (F.get(samples, 2 * i) + F.get(samples, 2 * i + 1)) / 2 / F.lit(32767.0))
    pairs = F.filter(pairs, lambda x: x.isNotNull())
    return F.when(F.size(samples) > 0, pairs).otherwise(F.raise_error(F.lit("empty audio")))


def alignment(reference_offset: Column, query_offset: Column) -> Column:
    return reference_offset - query_offset


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def song_name(name: Column, path: Column) -> Column:
    """The given name trimmed, else the file name without its extension, else ``unknown``."""
    given = F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit(""))
    return F.coalesce(given, F.nullif(base_name(F.coalesce(path, F.lit(""))), F.lit("")), F.lit("unknown"))
