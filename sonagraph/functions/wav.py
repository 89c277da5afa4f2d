"""WAV bytes: decoding to mono samples and encoding, with numpy."""

from __future__ import annotations

import struct

import numpy as np

PCM = 1


class WavError(ValueError):
    """A recording that cannot be read; ``args[0]`` is one of the messages below or a detail."""


# The messages that callers compare with.
NOT_WAV = "wav: not a RIFF/WAVE file"
NO_FORMAT = "wav: missing fmt chunk"
NO_DATA = "wav: missing data chunk"
UNSUPPORTED_FORMAT = "wav: unsupported audio format (only PCM supported)"
UNSUPPORTED_DEPTH = "wav: unsupported bit depth (only 8/16/32-bit supported)"
EMPTY_AUDIO = "audio: empty sample buffer"
KNOWN_ERRORS = (NOT_WAV, NO_FORMAT, NO_DATA, UNSUPPORTED_FORMAT, UNSUPPORTED_DEPTH, EMPTY_AUDIO)

#: bits -> dtype, offset, divisor
_DEPTHS = {8: ("u1", 128.0, 128.0), 16: ("<i2", 0.0, 32767.0), 32: ("<i4", 0.0, 2147483647.0)}


def is_wav_error(message: str | None) -> bool:
    return message in KNOWN_ERRORS


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, samples as the mean of the channels).  Chunks may come in any order; the last of
    each kind counts, others are skipped; chunks are padded to even length."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise WavError(NOT_WAV)
    at, fmt, body = 12, None, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        chunk = memoryview(data)[at + 8 : at + 8 + size]
        if kind in (b"fmt ", b"data") and len(chunk) < size:
            raise WavError(f"truncated {kind.decode().strip()} chunk")
        if kind == b"fmt ":
            if size < 16:
                raise WavError("truncated fmt chunk")
            fmt = struct.unpack_from("<HHIIHH", chunk)
        elif kind == b"data":
            body = chunk
        at += 8 + size + size % 2
    if fmt is None:
        raise WavError(NO_FORMAT)
    if body is None:
        raise WavError(NO_DATA)
    code, channels, rate, _, _, bits = fmt
    if code != PCM:
        raise WavError(UNSUPPORTED_FORMAT)
    if bits // 8 == 0 or channels == 0:
        raise WavError("invalid fmt chunk")
    frames = len(body) // (bits // 8 * channels)
    if frames == 0:
        raise WavError(EMPTY_AUDIO)
    if bits not in _DEPTHS:
        raise WavError(UNSUPPORTED_DEPTH)
    dtype, offset, scale = _DEPTHS[bits]
    values = np.frombuffer(body, dtype, frames * channels).astype(np.float64)
    return rate, ((values - offset) / scale).reshape(frames, channels).mean(axis=1)


def encode(samples: np.ndarray, sample_rate: int) -> bytes:
    """16-bit mono; clipped to [-1, 1], rounded half away from zero."""
    scaled = np.clip(np.asarray(samples, float), -1, 1) * 32767
    values = np.copysign(np.floor(np.abs(scaled) + 0.5), scaled).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(values), b"WAVE", b"fmt ", 16, PCM, 1, sample_rate, 2 * sample_rate, 2, 16, b"data", len(values))
    return head + values
