"""The byte form of the audio steps: RIFF/WAVE in and out of NumPy.

Called once per clip inside Arrow batches; Spark partitions the work.
"""

from __future__ import annotations

import struct

import numpy as np

from clipmill.schemas import TARGET_RATE

# Fixed values of the WAVE format.
FORMAT_PCM = 1
FORMAT_FLOAT = 3
FORMAT_EXTENSIBLE = 0xFFFE
EXTENSIBLE_GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")


class WavError(ValueError):
    """The bytes are not a WAV clip this package can decode."""


class WavInfo:
    __slots__ = ("format", "channels", "rate", "bits", "container", "data")

    def __init__(self, format, channels, rate, bits, container, data):
        self.format, self.channels, self.rate = format, channels, rate
        self.bits, self.container, self.data = bits, container, data


def _read_format(body: memoryview) -> tuple[int, int, int, int, int]:
    if len(body) < 16:
        raise WavError("invalid WAV: fmt chunk is too short")
    tag, channels, rate, byte_rate, block, bits = struct.unpack_from("<HHIIHH", body)
    if channels == 0:
        raise WavError("invalid WAV: header reports 0 channels")
    if rate == 0:
        raise WavError("invalid WAV: header reports sample rate 0")
    container = block // channels
    if bits > container * 8 or byte_rate != block * rate:
        raise WavError("invalid WAV: inconsistent fmt chunk")
    if tag == FORMAT_EXTENSIBLE:
        if len(body) < 40:
            raise WavError("invalid WAV: extensible fmt chunk is too short")
        valid_bits, _mask, tag = struct.unpack_from("<HIH", body, 18)
        if bytes(body[26:40]) != EXTENSIBLE_GUID_TAIL:
            raise WavError("unsupported WAV: unknown sample format GUID")
        bits = valid_bits or bits
    if tag not in (FORMAT_PCM, FORMAT_FLOAT):
        raise WavError(f"unsupported WAV: format tag {tag}")
    return tag, channels, rate, bits, container


def parse(raw) -> WavInfo:
    """Walk the RIFF chunks up to ``data``."""
    view = memoryview(raw)
    if len(view) < 12 or bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise WavError("not a WAV clip: no RIFF/WAVE header")
    spec, at = None, 12
    while at + 8 <= len(view):
        kind = bytes(view[at : at + 4])
        (length,) = struct.unpack_from("<I", view, at + 4)
        body = view[at + 8 : at + 8 + length]
        if kind == b"fmt ":
            spec = _read_format(body)
        elif kind == b"data":
            if spec is None:
                raise WavError("invalid WAV: data comes before the fmt chunk")
            if len(body) < length:
                raise WavError("truncated WAV: data chunk is cut off")
            tag, channels, rate, bits, container = spec
            if length % (container * channels):
                raise WavError("invalid WAV: data ends within a frame")
            return WavInfo(tag, channels, rate, bits, container, body)
        at += 8 + length + (length & 1)
    raise WavError("invalid WAV: no data chunk")


def _int24(data: memoryview, container: int) -> np.ndarray:
    octets = np.frombuffer(data, dtype=np.uint8).reshape(-1, container)
    padded = np.zeros((len(octets), 4), dtype=np.uint8)
    padded[:, 1:] = octets[:, :3]
    # The sample sits in the upper three bytes, so the shift extends its sign.
    return padded.view("<i4").ravel() >> 8


def _scaled(whole: np.ndarray, bits: int) -> np.ndarray:
    """Whole numbers over a power of two: multiplying by its inverse gives the same bits as dividing."""
    samples = whole.astype(np.float32)
    samples *= np.float32(2.0**-bits)
    return samples


def decode(info: WavInfo) -> np.ndarray:
    """Interleaved float32 samples in [-1, 1)."""
    layout = (info.format, info.bits, info.container)
    if layout == (FORMAT_PCM, 8, 1):
        # On disk 8-bit samples are unsigned around 128.
        return (np.frombuffer(info.data, "u1").astype(np.float32) - np.float32(128)) / np.float32(128)
    if layout == (FORMAT_PCM, 16, 2):
        return _scaled(np.frombuffer(info.data, "<i2"), 15)
    if layout in ((FORMAT_PCM, 24, 3), (FORMAT_PCM, 24, 4)):
        return _scaled(_int24(info.data, info.container), 23)
    if layout == (FORMAT_PCM, 32, 4):
        return _scaled(np.frombuffer(info.data, "<i4"), 31)
    if layout == (FORMAT_FLOAT, 32, 4):
        return np.frombuffer(info.data, "<f4").astype(np.float32)
    kind = "float" if info.format == FORMAT_FLOAT else "int"
    raise WavError(f"unsupported WAV: {info.bits} bit {kind} samples in {info.container} bytes")


def downmix(samples: np.ndarray, channels: int) -> np.ndarray:
    if channels == 1:
        return samples
    frames = samples[: len(samples) // channels * channels].reshape(-1, channels)
    total = frames[:, 0] + frames[:, 1]
    # Channel by channel: NumPy's own sum adds pairwise, in another order.
    for ch in range(2, channels):
        total += frames[:, ch]
    total /= np.float32(channels)
    return total


def resample_linear(samples: np.ndarray, in_rate: int, out_rate: int = TARGET_RATE) -> np.ndarray:
    if in_rate == out_rate or len(samples) == 0:
        return samples
    ratio = in_rate / out_rate
    position = np.arange(int(len(samples) / ratio), dtype=np.float64) * ratio
    left = position.astype(np.int64)
    weight = (position - left).astype(np.float32)
    right = np.minimum(left + 1, len(samples) - 1)
    return samples[left] * (np.float32(1) - weight) + samples[right] * weight


def to_pcm16(samples: np.ndarray) -> np.ndarray:
    scaled = np.clip(samples, np.float32(-1), np.float32(1))
    scaled *= np.float32(32767)
    if len(scaled) and np.isnan(scaled.min()):  # one NaN makes the minimum NaN
        scaled[np.isnan(scaled)] = 0
    return scaled.astype("<i2")


def encode(data: bytes, channels: int, rate: int, bits: int, tag: int = FORMAT_PCM) -> bytes:
    """Put the 44-byte header in front of sample bytes."""
    block = channels * bits // 8
    header = struct.pack(
        "<4sI4s4sIHHIIHH4sI",
        b"RIFF", 36 + len(data), b"WAVE",
        b"fmt ", 16, tag, channels, rate, rate * block, block, bits,
        b"data", len(data),
    )
    return header + data


def _keep_every(info: WavInfo, step: int) -> WavInfo:
    """Only the frames that resampling by a whole number picks."""
    width = info.container * info.channels
    # Frames as wide as a machine word are copied as numbers, several times as fast as opaque ones.
    frames = np.frombuffer(info.data, f"u{width}" if width in (1, 2, 4, 8) else f"V{width}")
    chosen = np.ascontiguousarray(frames[::step][: len(frames) // step])
    return WavInfo(info.format, info.channels, TARGET_RATE, info.bits, info.container, memoryview(chosen.view("u1")))


def canonicalize(raw) -> bytes:
    """Any supported WAV to 16 kHz mono 16-bit PCM WAV."""
    info = parse(raw)
    if info.format == FORMAT_PCM and info.rate > TARGET_RATE and info.rate % TARGET_RATE == 0:
        # Every position falls on a sample, with weight 0 for the next one: no arithmetic is needed.
        info = _keep_every(info, info.rate // TARGET_RATE)
    if (info.format, info.bits, info.container, info.channels, info.rate) == (FORMAT_PCM, 16, 2, 1, TARGET_RATE):
        # Dividing by 32,768 and multiplying by 32,767 moves each value one step toward zero.
        stored = np.frombuffer(info.data, "<i2")
        pcm = (stored - np.sign(stored)).astype("<i2")
    else:
        pcm = to_pcm16(resample_linear(downmix(decode(info), info.channels), info.rate))
    return encode(pcm.tobytes(), 1, TARGET_RATE, 16)
