"""Signals held as arrays of samples: mixing, resampling, levels, voiced spans, as higher-order functions.

Arrays here are chunks of bounded length (seconds of sound), so that interpreted higher-order functions do; long signals
are cut into chunks first (operators.audio)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

SILENCE = -200.0

#: Milliseconds of a level window; quantile of the noise floor; margin, lowest and highest threshold in dBFS.
WINDOW_MS = 30
FLOOR_QUANTILE = 0.20
MARGIN, LOWEST, HIGHEST = 12.0, -60.0, -40.0

#: Shortest voiced span and padding in seconds.
SHORTEST, PADDING = 0.1, 0.2


def total(values: Column) -> Column:
    """Sum in array order, in double precision."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def downmix(samples: Column, channels: Column) -> Column:
    """Mean over interleaved channels, single precision."""
    frame = lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0).cast("float"), lambda a, x: (a + x).cast("float"))
    n = F.floor(F.size(samples) / channels).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (frame(i) / channels.cast("float")).cast("float"))).otherwise(F.array().cast("array<float>"))


def resample(samples: Column, rate: Column, to_rate: Column) -> Column:
    """Linear, at least one value, the last value is held beyond the end."""
    n = F.greatest(F.lit(1), F.round(F.size(samples) * (to_rate / rate)).cast("int"))
    last = F.size(samples) - 1

    def at(i: Column) -> Column:
        pos = i * (rate / to_rate)
        low = F.least(F.floor(pos).cast("int"), last)
        a, b = F.get(samples, low).cast("double"), F.get(samples, F.least(low + 1, last)).cast("double")
        return (a + (b - a) * (pos - low)).cast("float")

    return F.when(F.size(samples) > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<float>"))


def level(samples: Column) -> Column:
    """A10: RMS in dBFS."""
    mean = total(F.transform(samples, lambda x: (x * x).cast("double"))) / F.size(samples)
    return F.when(F.size(samples) > 0, 20 * F.log10(F.greatest(F.sqrt(mean), F.lit(1e-10)))).otherwise(F.lit(SILENCE))


def window_samples(rate: Column) -> Column:
    return F.greatest(F.lit(1), F.round(rate * WINDOW_MS / 1000).cast("int"))


def levels(samples: Column, window: Column) -> Column:
    """Levels of whole windows."""
    n = F.floor(F.size(samples) / window).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: level(F.slice(samples, i * window + 1, window)))).otherwise(F.array().cast("array<double>"))


def noise_floor(db: Column) -> Column:
    """The value at floor(q (n - 1)) of the sorted levels."""
    return F.get(F.array_sort(db), F.floor(F.lit(FLOOR_QUANTILE) * (F.size(db) - 1)).cast("int"))


def threshold(db: Column) -> Column:
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), noise_floor(db) + MARGIN))


def voiced_span(db: Column, limit: Column, window: Column, rate: Column, n_samples: Column) -> Column:
    """(first sample, after the last) from the first to the last window at the limit or over, padded and clamped; null if too short."""
    at = F.filter(F.transform(db, lambda x, i: F.when(x >= limit, i)), lambda i: i.isNotNull())
    first, after = F.array_min(at) * window, (F.array_max(at) + 1) * window
    pad = F.round(rate * PADDING).cast("int")
    return F.when((F.size(at) > 0) & ((after - first) / rate >= SHORTEST), F.struct(F.greatest(F.lit(0), first - pad).alias("start"), F.least(n_samples, after + pad).alias("end")))


def correlation(a: Column, b: Column) -> Column:
    """Absolute cosine over the shared prefix, 0 without energy."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(s, 1, n), lambda v: v.cast("double")) for s in (a, b))
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    energy = F.sqrt(total(F.transform(x, lambda v: v * v)) * total(F.transform(y, lambda v: v * v)))
    return F.when((n > 0) & (energy > 0), F.abs(dot) / energy).otherwise(F.lit(0.0))


def quantize(samples: Column) -> Column:
    """16-bit integers, clamped to [-1, 1]."""
    clamped = F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))))
    return F.transform(clamped, lambda x: F.round(F.when(x < 0, x * 32768).otherwise(x * 32767)).cast("int"))


@F.pandas_udf(BinaryType())
def wav_bytes(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A mono 16-bit WAV file of quantised samples and a sample rate, 44 bytes of header first."""
    import struct

    for values, rates in parts:
        out = []
        for v, r in zip(values, rates, strict=True):
            data = np.asarray(v, "<i2").tobytes()
            out.append(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, int(r), int(r) * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data)
        yield pd.Series(out)


def chunk_file_name(source: Column, number: Column) -> Column:
    return F.format_string("%s-chunk-%04d.wav", source, number)


#: How stored samples of each format become single-precision ones: numpy's type, divisor, offset.
PCM_FORMATS = {"float32": ("<f4", 1.0, 0.0), "float64": ("<f8", 1.0, 0.0), "int16": ("<i2", 32767.0, 0.0), "int32": ("<i4", 2147483647.0, 0.0), "uint8": ("u1", 128.0, -128.0)}


@F.pandas_udf(ArrayType(FloatType()))
def decode_pcm(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Bytes and the name of their format; zeros for an unknown one."""
    for raw, formats in parts:
        out = []
        for b, f in zip(raw, formats, strict=True):
            if b is None:
                out.append(None)
            elif f in PCM_FORMATS:
                kind, by, off = PCM_FORMATS[f]
                out.append(((np.frombuffer(b, kind).astype(np.float64) + off) / by).astype(np.float32))
            else:
                out.append(np.zeros(len(b), np.float32))
        yield pd.Series(out)


def interleave(planes: Column) -> Column:
    """Array of channels -> one array, frame by frame."""
    n = F.array_min(F.transform(planes, lambda p: F.size(p)))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(planes, lambda p: F.get(p, i))))).otherwise(F.array().cast("array<float>"))
