"""Audio steps on ``array<float>`` samples as Column expressions, without Python workers.

Arithmetic is single precision in a fixed order, so the byte codec in ``wav`` gives the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipmill.functions.once import once
from clipmill.schemas import TARGET_RATE


def _f32(value: float) -> Column:
    return F.lit(value).cast("float")


def _indices(count: Column) -> Column:
    """0 .. count-1, empty for 0."""
    # ``sequence(0, -1)`` counts down, so the empty case is spelled out.
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def downmix(samples: Column, channels: Column) -> Column:
    """Mean of each interleaved frame; an incomplete last frame is dropped."""
    n = channels.cast("int")

    def mix(x: Column) -> Column:
        def mean_of(frame: Column) -> Column:
            total = F.aggregate(
                F.sequence(F.lit(0), n - 1), _f32(0.0), lambda acc, ch: acc + F.get(x, frame * n + ch)
            )
            return (total / n.cast("float")).cast("float")

        frames = F.floor(F.size(x) / n).cast("int")
        return F.when(n == 1, x).otherwise(F.transform(_indices(frames), mean_of))

    return once(samples, mix)


def resample_linear(samples: Column, in_rate: Column, out_rate: int = TARGET_RATE) -> Column:
    """Linear interpolation to ``out_rate``; the last sample repeats at the edge."""
    ratio = in_rate.cast("double") / F.lit(float(out_rate))

    def interpolate(x: Column) -> Column:
        size = F.size(x)

        def at(i: Column) -> Column:
            position = i.cast("double") * ratio
            left = F.floor(position).cast("int")
            weight = (position - left.cast("double")).cast("float")
            first = F.get(x, left)
            second = F.get(x, F.least(left + 1, size - 1))
            return first * (_f32(1.0) - weight) + second * weight

        out_len = F.floor(size.cast("double") / ratio).cast("int")
        same = (in_rate == out_rate) | (size == 0)
        return F.when(same, x).otherwise(F.transform(_indices(out_len), at))

    return once(samples, interpolate)


def to_pcm16(samples: Column) -> Column:
    """Clamp to [-1, 1], scale by 32,767, truncate toward zero; NaN becomes 0."""

    def quantize(x: Column) -> Column:
        clamped = F.greatest(_f32(-1.0), F.least(_f32(1.0), x))
        return F.when(F.isnan(x), F.lit(0)).otherwise((clamped * _f32(32767.0)).cast("int")).cast("smallint")

    return F.transform(samples, quantize)


def canonical_pcm(samples: Column, channels: Column, sample_rate: Column) -> Column:
    """Interleaved float samples to 16 kHz mono PCM16 values."""
    return to_pcm16(resample_linear(downmix(samples, channels), sample_rate))
