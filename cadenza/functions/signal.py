"""Functions over sample vectors (arrays of numbers): resampling, loudness, PCM, voice activity, filters."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.scalars import ColumnLike, col


def resampled(x: ColumnLike, n: int) -> Column:
    """``n`` samples by linear interpolation, first and last kept."""
    a = col(x)
    at = lambda i: F.lit(float(i)) * (F.size(a) - 1) / (n - 1)
    parts = [F.struct(F.floor(at(i)).cast("int").alias("k"), (at(i) - F.floor(at(i))).alias("f")) for i in range(n)]
    value = lambda p: F.get(a, p["k"]) * (1 - p["f"]) + F.coalesce(F.get(a, p["k"] + 1), F.get(a, p["k"])) * p["f"]
    return F.transform(F.array(*parts), value)


def block_powers(x: ColumnLike, length: int, hop: int) -> Column:
    """Mean square of every whole block of ``length`` samples, one every ``hop``."""
    a = col(x)
    starts = F.when(F.size(a) >= length, F.sequence(F.lit(1), F.size(a) - length + 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.aggregate(F.slice(a, s, length), F.lit(0.0), lambda t, v: t + v * v) / length)


def loudness(power: ColumnLike) -> Column:
    return F.lit(-0.691) + 10 * F.log10(col(power) + F.lit(1e-30))


def integrated_loudness(powers: ColumnLike, absolute: float = -70.0, relative: float = -10.0) -> Column:
    """Mean loudness of blocks above an absolute gate, and then above the mean of those less 10."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.when(F.size(a) > 0, F.size(a))
    loud = F.filter(col(powers), lambda p: loudness(p) > absolute)
    gate = loudness(mean(loud)) + relative
    return loudness(mean(F.filter(loud, lambda p: loudness(p) > gate)))


def to_pcm16(x: ColumnLike) -> Column:
    """Floats in -1 .. 1, clipped, to 16-bit whole numbers."""
    return F.transform(col(x), lambda v: F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double"))) * 32767 + 0.5).cast("int"))


def from_pcm16(x: ColumnLike) -> Column:
    return F.transform(col(x), lambda v: v / F.lit(32768.0))


def voice_segments(probabilities: np.ndarray, threshold: float, release: float, min_silence: int, min_speech: int, pad: int) -> list[tuple[int, int]]:
    """[start, end) frames of speech: begun at ``threshold``, ended after ``min_silence`` frames below
    threshold - release, dropped below ``min_speech``, padded without meeting a neighbour."""
    out: list[list[int]] = []
    start, quiet = None, None
    for i, p in enumerate(probabilities):
        if p >= threshold:
            quiet = None
            start = i if start is None else start
        elif p < threshold - release and start is not None:
            quiet = i if quiet is None else quiet
            if i - quiet + 1 >= min_silence:
                out.append([start, quiet])
                start = quiet = None
    if start is not None:
        out.append([start, len(probabilities) if quiet is None else quiet])
    out = [s for s in out if s[1] - s[0] >= min_speech]
    for i, s in enumerate(out):
        s[0] = max(s[0] - pad, 0 if i == 0 else (out[i - 1][1] + s[0] + 1) // 2 if s[0] - out[i - 1][1] < pad else s[0] - pad)
        room = (out[i + 1][0] if i + 1 < len(out) else len(probabilities)) - s[1]
        s[1] += min(pad, room // 2 if i + 1 < len(out) and room < 2 * pad else room)
    return [(a, b) for a, b in out]


def voice_activity(probabilities: ColumnLike, threshold: float = 0.5, release: float = 0.15, min_silence: int = 4, min_speech: int = 2, pad: int = 1) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[] if v is None else [{"start": a, "end": b} for a, b in voice_segments(np.asarray(v), threshold, release, min_silence, min_speech, pad)] for v in s])

    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return F.pandas_udf(run, kind)(col(probabilities))


#: Fixed values of the loudness standard: the shelf (gain in dB, frequency, quality, exponent) and the high-pass after it.
SHELF_DB, SHELF_HZ, SHELF_Q, SHELF_EXPONENT = 3.999843853973347, 1681.974450955533, 0.7071752369554196, 0.4996667741545416
PASS_HZ, PASS_Q = 38.13547087602444, 0.5003270373238773


def k_weighting(rate: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The two stages of K-weighting at a sample rate, each as (b0, b1, b2, a1, a2), by the bilinear transform."""

    def stage(hz: float, q: float, top: tuple[float, float, float]) -> tuple[float, ...]:
        k = math.tan(math.pi * hz / rate)
        scale = 1 + k / q + k * k
        high, band, low = top  # of the transfer function: (high s^2 + band s + low) / (s^2 + s / q + 1)
        b = (high + band * k / q + low * k * k, 2 * (low * k * k - high), high - band * k / q + low * k * k)
        return (*(v / scale for v in b), 2 * (k * k - 1) / scale, (1 - k / q + k * k) / scale)

    gain = 10 ** (SHELF_DB / 20)
    shelf = stage(SHELF_HZ, SHELF_Q, (gain, gain**SHELF_EXPONENT, 1.0))
    return shelf, stage(PASS_HZ, PASS_Q, (1.0, 0.0, 0.0))


def biquad(samples: np.ndarray, c: tuple[float, ...]) -> list[float]:
    """A second-order recursive filter over one recording, its two delays as the only memory."""
    b0, b1, b2, a1, a2 = c
    first = second = 0.0
    out = []
    for v in samples:
        y = b0 * v + first
        first, second = b1 * v - a1 * y + second, b2 * v - a2 * y
        out.append(y)
    return out


def k_weighted(x: ColumnLike, rate: float = 16000.0) -> Column:
    """Samples as loudness hears them: both stages of K-weighting, a recurrence and so an Arrow UDF."""
    shelf, high_pass = k_weighting(rate)
    return F.pandas_udf(lambda s: pd.Series([None if v is None else biquad(biquad(v, shelf), high_pass) for v in s]), T.ArrayType(T.DoubleType()))(col(x))


def wav_bytes(samples: ColumnLike, rate: int = 16000, seconds: float | None = None) -> Column:
    """Floats as a WAV file, filled with silence up to ``seconds`` where given."""

    def run(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            if v is None:
                out.append(None)
                continue
            pcm = (np.clip(np.asarray(v, dtype=float), -1, 1) * 32767).round().astype("<i2")
            if seconds is not None:
                pcm = np.pad(pcm, (0, max(0, int(round(seconds * rate)) - len(pcm))))
            file = io.BytesIO()
            with wave.open(file, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(rate)
                w.writeframes(pcm.tobytes())
            out.append(file.getvalue())
        return pd.Series(out)

    return F.pandas_udf(run, T.BinaryType())(col(samples))


def wav_samples(content: ColumnLike) -> Column:
    """Samples of a WAV file, channels mixed down by their mean, as floats."""

    def run(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            if v is None:
                out.append(None)
                continue
            with wave.open(io.BytesIO(v)) as w:
                pcm = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels())
            out.append((pcm.mean(axis=1) / 32768).tolist())
        return pd.Series(out)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(col(content))
