"""Queries of the audio steps: array form by SQL, byte form on WAV files made from the same samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipmill.functions import wav, waveform
from clipmill.operators import audio
from workload.registry import query
from workload.tables import Tables, oracle

# Source sample formats by clip_id % 5: bits, scale to integers, divisor when decoding.
FORMATS = {0: (8, 127, 128), 1: (16, 32767, 32768), 2: (24, 8388607, 8388608), 3: (32, 2147483520, 2147483648)}
FLOAT_BITS = 32


# ---- DuckDB -----------------------------------------------------------------------------------

_MONO = """
    select clip_id, sample_rate,
           case when channels = 1 then samples
                else [((samples[2 * i + 1] + samples[2 * i + 2]) / 2::FLOAT)::FLOAT for i in range(0, len(samples) // 2)]
           end mono
    from {source}"""

_RESAMPLED = """
    select clip_id,
           case when sample_rate = 16000 then mono
                else [(mono[cast(floor(i * ratio) as int) + 1] * (1::FLOAT - (i * ratio - floor(i * ratio))::FLOAT)
                       + mono[least(cast(floor(i * ratio) as int) + 2, len(mono))] * (i * ratio - floor(i * ratio))::FLOAT)::FLOAT
                      for i in range(0, cast(floor(len(mono) / ratio) as bigint))]
           end resampled
    from (select *, sample_rate / 16000::DOUBLE ratio from mono_clips)"""

_PCM = """
    select clip_id, [cast(trunc(greatest((-1)::FLOAT, least(1::FLOAT, x)) * 32767::FLOAT) as int) for x in resampled] pcm
    from resampled_clips"""

# What decoding gives back for samples that were stored in each source format.
_DECODED = (
    "select clip_id, channels, sample_rate, case clip_id % 5 "
    + " ".join(
        f"when {i} then [cast(trunc(x * {scale}::FLOAT) as int)::FLOAT / {div}::FLOAT for x in samples]"
        for i, (_, scale, div) in FORMATS.items()
    )
    + " else samples end samples from waveforms"
)


def pcm_oracle(body: str, source: str = "waveforms", *views: str, **more: str) -> str:
    return oracle(
        body,
        "waveforms",
        *views,
        **more,
        mono_clips=_MONO.replace("{source}", source),
        resampled_clips=_RESAMPLED,
        pcm_clips=_PCM,
    )


# ---- Spark ------------------------------------------------------------------------------------


def numbers_text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# Columns of a waveform that its WAV file is made of.
WAV_INPUTS = ("clip_id", "samples", "channels", "sample_rate")


def named_waveforms(t: Tables) -> DataFrame:
    """The waveforms with ``clip_path``, the name of their WAV file."""
    path = F.concat(F.lit("clips/"), F.col("clip_id").cast("string"), F.lit(".wav"))
    return t.waveforms.withColumn("clip_path", path)


def wav_maker():
    """What makes a waveform's WAV file, in one of five sample formats; a closure, as workers know ``clipmill`` only."""

    def make(row) -> bytes:
        samples = np.asarray(row["samples"].values, dtype=np.float32)
        channels, rate = row["channels"].as_py(), row["sample_rate"].as_py()
        kind = row["clip_id"].as_py() % 5
        if kind not in FORMATS:
            data = wav.encode(samples.astype("<f4").tobytes(), channels, rate, FLOAT_BITS, wav.FORMAT_FLOAT)
        else:
            bits, scale, _ = FORMATS[kind]
            stored = np.trunc(samples * np.float32(scale)).astype(np.int32)
            if bits == 8:
                packed = (stored + 128).astype("u1").tobytes()
            elif bits == 24:
                packed = stored.astype("<i4").view("u1").reshape(-1, 4)[:, :3].tobytes()
            else:
                packed = stored.astype(f"<i{bits // 8}").tobytes()
            data = wav.encode(packed, channels, rate, bits)
        return data

    return make


def source_wavs(t: Tables) -> DataFrame:
    """Each waveform as a WAV file in one of five sample formats: ``clip_id, path, content``."""
    made = T.StructType([T.StructField("content", T.BinaryType())])
    make = wav_maker()

    def convert(row):
        data = make(row)
        return {"content": data}, len(data)

    wavs = audio.map_rows(named_waveforms(t), convert, WAV_INPUTS, made)
    return wavs.select("clip_id", "clip_path", "content")


def pcm_of(df: DataFrame, content: str = "bytes") -> DataFrame:
    """Decode canonical clips again and give their 16-bit values as text."""
    decoded = audio.decode_clips(df, content)
    values = F.transform("samples", lambda x: (x * F.lit(32768.0).cast("float")).cast("int"))
    return decoded.withColumn("n_samples", F.size("samples").cast("bigint")).withColumn("pcm", numbers_text(values))


@query(
    "downmix",
    oracle(
        f"select clip_id, len(mono) n_samples, array_to_string([cast(trunc(x * 1048576::FLOAT) as int) for x in mono], ',') mono from ({_MONO})".replace(
            "{source}", "waveforms"
        ),
        "waveforms",
    ),
)
def _(t):
    mono = waveform.downmix(F.col("samples"), F.col("channels"))
    whole = F.transform("mono", lambda x: (x * F.lit(1048576.0).cast("float")).cast("int"))
    mixed = t.waveforms.select("clip_id", mono.alias("mono"))
    return mixed.select("clip_id", F.size("mono").cast("bigint").alias("n_samples"), numbers_text(whole).alias("mono"))


@query(
    "resample_linear",
    pcm_oracle(
        """select clip_id, len(resampled) n_samples,
                  array_to_string([cast(trunc(x * 1048576::FLOAT) as int) for x in resampled], ',') resampled from resampled_clips"""
    ),
)
def _(t):
    mono = t.waveforms.select("clip_id", "sample_rate", waveform.downmix(F.col("samples"), F.col("channels")).alias("mono"))
    changed = mono.select("clip_id", waveform.resample_linear(F.col("mono"), F.col("sample_rate")).alias("resampled"))
    whole = F.transform("resampled", lambda x: (x * F.lit(1048576.0).cast("float")).cast("int"))
    return changed.select("clip_id", F.size("resampled").cast("bigint").alias("n_samples"), numbers_text(whole).alias("resampled"))


@query(
    "to_pcm16",
    oracle(
        """select clip_id, array_to_string([cast(trunc(greatest((-1)::FLOAT, least(1::FLOAT, x * 4::FLOAT)) * 32767::FLOAT) as int)
                                            for x in samples], ',') pcm from waveforms""",
        "waveforms",
    ),
)
def _(t):
    # Four times louder, so that some samples are clamped.
    loud = F.transform("samples", lambda x: x * F.lit(4.0).cast("float"))
    return t.waveforms.select("clip_id", numbers_text(waveform.to_pcm16(loud)).alias("pcm"))


@query("canonical_pcm_arrays", pcm_oracle("select clip_id, len(pcm) n_samples, array_to_string(pcm, ',') pcm from pcm_clips"))
def _(t):
    pcm = waveform.canonical_pcm(F.col("samples"), F.col("channels"), F.col("sample_rate"))
    clips = t.waveforms.select("clip_id", pcm.alias("pcm"))
    return clips.select("clip_id", F.size("pcm").cast("bigint").alias("n_samples"), numbers_text(F.col("pcm")).alias("pcm"))


@query(
    "decode_clips",
    oracle(
        """select clip_id, channels, sample_rate, case clip_id % 5 when 0 then 8 when 1 then 16 when 2 then 24 else 32 end bits,
                  case clip_id % 5 when 4 then 'float' else 'int' end format,
                  array_to_string([cast(trunc(x * 1048576::FLOAT) as int) for x in samples], ',') samples, cast(null as varchar) error
           from decoded""",
        "waveforms",
        decoded=_DECODED,
    ),
)
def _(t):
    whole = F.transform("samples", lambda x: (x * F.lit(1048576.0).cast("float")).cast("int"))
    return audio.decode_clips(source_wavs(t)).drop("clip_path").withColumn("samples", numbers_text(whole))


@query(
    "canonicalize_clips",
    pcm_oracle(
        """select p.clip_id, 1 channels, 16000 sample_rate, 16 bits, len(pcm) n_samples, array_to_string(pcm, ',') pcm
           from pcm_clips p""",
        source="decoded",
        decoded=_DECODED,
    ),
)
def _(t):
    clips = pcm_of(audio.canonicalize_clips(source_wavs(t)))
    return clips.select("clip_id", "channels", "sample_rate", "bits", "n_samples", "pcm")


@query(
    "quarantined_clips",
    oracle("select clip_id, clip_id % 3 <> 0 broken from waveforms", "waveforms"),
)
def _(t):
    # Two of three clips lose their last byte or their header.
    damaged = source_wavs(t).withColumn(
        "content",
        F.when(F.col("clip_id") % 3 == 1, F.expr("left(content, octet_length(content) - 1)"))
        .when(F.col("clip_id") % 3 == 2, F.expr("substr(content, 9)"))
        .otherwise(F.col("content")),
    )
    clips = audio.canonicalize_clips(damaged, on_error="quarantine")
    return clips.select("clip_id", F.col("error").isNotNull().alias("broken"))
