import struct

import numpy as np
import pytest
from conftest import make_wav
from pyspark.sql import functions as F

from clipmill.functions import wav, waveform
from clipmill.operators import audio


def pcm(data):
    info = wav.parse(data)
    assert (info.channels, info.rate, info.bits) == (1, 16_000, 16)
    return np.frombuffer(info.data, "<i2")


def slow_canonical(samples, channels, rate):
    """The audio steps sample by sample in single precision."""
    f32 = np.float32
    mono = []
    for at in range(0, len(samples) // channels * channels, channels):
        total = f32(0)
        for ch in range(channels):
            total = f32(total + f32(samples[at + ch]))
        mono.append(f32(total / f32(channels)) if channels > 1 else f32(samples[at]))
    if rate != 16_000 and mono:
        ratio, out = rate / 16_000, []
        for i in range(int(len(mono) / ratio)):
            left = int(i * ratio)
            weight = f32(i * ratio - left)
            first, second = mono[left], mono[min(left + 1, len(mono) - 1)]
            out.append(f32(f32(first * f32(f32(1) - weight)) + f32(second * weight)))
        mono = out
    return [int(f32(min(max(x, f32(-1)), f32(1)) * f32(32767))) for x in mono]


def test_same_rate_keeps_length():
    assert len(pcm(wav.canonicalize(make_wav([0.1] * 100)))) == 100


def test_every_16_bit_value_moves_one_step_toward_zero():
    values = np.arange(-32768, 32768, dtype=np.int32)
    got = pcm(wav.canonicalize(wav.encode(values.astype("<i2").tobytes(), 1, 16_000, 16)))
    assert (got == values - np.sign(values)).all()
    # The general path agrees with the short cut.
    assert (wav.to_pcm16(wav.decode(wav.parse(wav.encode(values.astype("<i2").tobytes(), 1, 16_000, 16)))) == got).all()


def test_opposite_channels_cancel():
    stereo = make_wav([1.0, -1.0] * 100, channels=2)
    eight = make_wav(([1.0] * 4 + [-1.0] * 4) * 50, channels=8)
    assert np.abs(pcm(wav.canonicalize(stereo))).max() <= 1 and len(pcm(wav.canonicalize(stereo))) == 100
    assert np.abs(pcm(wav.canonicalize(eight))).max() <= 1 and len(pcm(wav.canonicalize(eight))) == 50


def test_resampling_thirds():
    assert len(pcm(wav.canonicalize(make_wav([0.0] * 480, rate=48_000)))) == 160


@pytest.mark.parametrize("rate", [8_000, 11_025, 16_000, 22_050, 44_100, 48_000])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_matches_a_sample_by_sample_walk(rate, channels):
    samples = np.random.default_rng(rate + channels).uniform(-1.2, 1.2, 300 * channels).astype(np.float32)
    data = wav.encode(samples.tobytes(), channels, rate, 32, wav.FORMAT_FLOAT)
    assert pcm(wav.canonicalize(data)).tolist() == slow_canonical(samples, channels, rate)


@pytest.mark.parametrize("rate", [32_000, 48_000, 96_000])
@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_whole_rate_steps_equal_interpolation(rate, bits):
    rng = np.random.default_rng(rate + bits)
    for frames in (0, 1, 2, 3, 5, 100, 101):
        for channels in (1, 2):
            raw = rng.bytes(frames * channels * bits // 8)
            info = wav.parse(wav.encode(raw, channels, rate, bits))
            slow = wav.to_pcm16(wav.resample_linear(wav.downmix(wav.decode(info), channels), rate))
            assert (pcm(wav.canonicalize(wav.encode(raw, channels, rate, bits))) == slow).all()


def test_sample_formats():
    def decoded(raw, bits, tag=wav.FORMAT_PCM):
        return wav.decode(wav.parse(wav.encode(raw, 1, 16_000, bits, tag))).tolist()

    assert decoded(bytes([0, 64, 128, 255]), 8) == [-1.0, -0.5, 0.0, 127 / 128]
    assert decoded(struct.pack("<3h", -32768, 0, 16384), 16) == [-1.0, 0.0, 0.5]
    assert decoded(b"\x00\x00\x80" + b"\x00\x00\x40" + b"\xff\xff\xff", 24) == [-1.0, 0.5, -1 / 2**23]
    assert decoded(struct.pack("<2i", -(2**31), 2**30), 32) == [-1.0, 0.5]
    assert decoded(struct.pack("<2f", 0.25, -2.0), 32, wav.FORMAT_FLOAT) == [0.25, -2.0]


def test_extensible_header_with_24_bits_in_4_bytes():
    data = struct.pack("<2i", 0x400000, -0x400000)
    fmt = struct.pack("<HHIIHHHHIH", wav.FORMAT_EXTENSIBLE, 1, 16_000, 64_000, 4, 32, 22, 24, 4, wav.FORMAT_PCM)
    fmt += wav.EXTENSIBLE_GUID_TAIL
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    clip = b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks
    assert wav.decode(wav.parse(clip)).tolist() == [0.5, -0.5]


def test_other_chunks_are_skipped():
    clip = make_wav([0.5] * 8)
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    assert (pcm(wav.canonicalize(clip[:12] + extra + clip[12:])) == pcm(wav.canonicalize(clip))).all()


@pytest.mark.parametrize(
    "data",
    [
        b"",
        b"definitely not a wav",
        make_wav([0.0] * 8)[:-3],
        make_wav([0.0] * 8)[:40],
        wav.encode(b"\0" * 16, 1, 16_000, 64, wav.FORMAT_FLOAT),
        wav.encode(b"\0" * 6, 2, 16_000, 16),
        wav.encode(b"", 1, 0, 16),
        wav.encode(b"\0" * 16, 1, 16_000, 16, tag=2),
        b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + struct.pack("<HHIIHH", 1, 0, 16_000, 0, 0, 16),
    ],
)
def test_bad_clips_are_refused(data):
    with pytest.raises(wav.WavError):
        wav.canonicalize(data)


def test_nan_becomes_silence(spark):
    values = [float("nan"), 1.0, -1.0, 2.0, float("inf"), float("-inf")]
    assert wav.to_pcm16(np.array(values, np.float32)).tolist() == [0, 32767, -32767, 32767, 32767, -32767]
    df = spark.createDataFrame([(values,)], "s array<float>")
    assert df.select(waveform.to_pcm16(F.col("s"))).head()[0] == [0, 32767, -32767, 32767, 32767, -32767]


def test_array_form_equals_byte_form(spark):
    rng = np.random.default_rng(1)
    cases = [(n, ch, rate) for n in (0, 1, 2, 5, 333) for ch in (1, 2, 3, 8) for rate in (8_000, 16_000, 44_100, 48_000)]
    rows, clips = [], []
    for i, (n, ch, rate) in enumerate(cases):
        samples = rng.uniform(-1.1, 1.1, n * ch).astype(np.float32)
        rows.append((i, samples.tolist(), ch, rate))
        clips.append((i, f"clips/{i}.wav", wav.encode(samples.tobytes(), ch, rate, 32, wav.FORMAT_FLOAT)))
    arrays = spark.createDataFrame(rows, "i int, s array<float>, ch int, rate int").select(
        "i", waveform.canonical_pcm(F.col("s"), F.col("ch"), F.col("rate")).alias("pcm")
    )
    files = audio.canonicalize_clips(spark.createDataFrame(clips, "i int, clip_path string, content binary"))
    by_bytes = {r.i: pcm(r.bytes).tolist() for r in files.collect()}
    assert {r.i: r.pcm for r in arrays.collect()} == by_bytes


def test_large_batches_are_cut(spark, monkeypatch):
    monkeypatch.setattr(audio, "BATCH_BYTES", 100)
    rows = [(i, f"{i}", make_wav([i / 100] * 10)) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, clip_path string, content binary").coalesce(1)
    got = audio.canonicalize_clips(df).collect()
    assert [r.i for r in got] == list(range(50))
    assert all((pcm(r.bytes) == pcm(wav.canonicalize(rows[r.i][2]))).all() for r in got)


def test_quarantine_keeps_good_rows(spark):
    rows = [("clips/good.wav", make_wav([0.5])), ("clips/bad.wav", b"noise"), ("clips/none.wav", None)]
    df = spark.createDataFrame(rows, "clip_path string, content binary")
    found = {r.clip_path: r for r in audio.canonicalize_clips(df, on_error="quarantine").collect()}
    assert found["clips/good.wav"].error is None and found["clips/good.wav"].bytes
    assert "clips/bad.wav" in found["clips/bad.wav"].error and found["clips/bad.wav"].bytes is None
    assert found["clips/none.wav"].error
    with pytest.raises(Exception, match="clips/(bad|none).wav"):
        audio.canonicalize_clips(df).collect()
    with pytest.raises(ValueError):
        audio.canonicalize_clips(df, on_error="ignore")


def test_files_of_any_length_in_one_task(spark, tmp_path):
    """Buffers go from clip to clip: short after long, long after short, empty and broken ones."""
    rng = np.random.default_rng(3)
    lengths = [20_000, 1, 900, 40_000, 0, 17, 300_000, 5]
    for i, n in enumerate(lengths * 4):
        data = make_wav(rng.uniform(-1, 1, n), rate=(16_000, 44_100, 48_000)[i % 3])
        (tmp_path / f"{i}.wav").write_bytes(data)
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "cut.wav").write_bytes(make_wav([0.5] * 50)[:-7])
    names = sorted(p.name for p in tmp_path.iterdir())
    rows = spark.createDataFrame([(n, n) for n in names], "rel string, clip_path string").coalesce(1)
    got = {r.clip_path: r for r in audio.try_canonicalize_files(rows, str(tmp_path)).collect()}
    assert set(got) == set(names)
    for name, row in got.items():
        try:
            want = wav.canonicalize((tmp_path / name).read_bytes())
        except wav.WavError:
            want = None
        assert (row.bytes, row.error is None) == (want, want is not None)
    assert got["empty.wav"].bytes is None and got["cut.wav"].bytes is None
