"""Signals in stretches: rational-rate resampling and log-mel spectrograms.

A signal is rows (clip, at, samples): `at` is the place of the first sample, and a clip may have any number of rows. Work is
dealt in windows of output, each with the input that it reaches beyond its own; so a clip of any length is spread over tasks,
and no task holds more than a window. Samples that no row has count as silence, rows that overlap add up. Everything is in
double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.contracts import ContractError

#: Output samples, and spectrogram frames, of a window.
WINDOW, FRAMES = 16_384, 256
# fixed values of the resampling filter: zero crossings on each side, and the shape of its Kaiser window
CROSSINGS, SHAPE = 10, 5.0
# fixed values of the spectrogram: rate, transform and hop length, bands, silence at the end, floor of power, range, shift and scale
RATE, N_FFT, HOP, N_MELS, TAIL, LEAST, RANGE, SHIFT = 16_000, 400, 160, 128, 479, 1e-10, 8.0, 4.0
# fixed values of the mel scale: hertz a mel below the break, the break, and the ratio of 27 mels above it
MEL_HZ, MEL_BREAK, MEL_RATIO, MEL_STEPS = 200.0 / 3.0, 1000.0, 6.4, 27.0


def fir_taps(up: int, down: int) -> np.ndarray:
    """The low-pass filter between the two rates: a windowed sinc of unit gain, times the rate it is applied at."""
    top = max(up, down)
    half = CROSSINGS * top
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / top) / top * np.kaiser(2 * half + 1, SHAPE)
    return taps / taps.sum() * up


def _overlapping(signals: DataFrame, first: Column, last: Column, lengths: DataFrame) -> DataFrame:
    """clip, window, pieces (at, samples) in order, length: each row of samples goes to the windows from `first` to `last`, which
    are expressions of its first and last place."""
    rows = signals.select("clip", F.col("at").cast("long").alias("at"), F.col("samples").cast("array<double>").alias("samples")).where("size(samples) > 0")
    sent = rows.select("clip", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), F.greatest(last, F.lit(0)).cast("long"))).alias("window"), F.struct("at", "samples").alias("piece"))
    return sent.groupBy("clip", "window").agg(F.sort_array(F.collect_list("piece")).alias("pieces")).join(lengths, "clip")


def clip_lengths(signals: DataFrame) -> DataFrame:
    """clip, length: up to its last sample. A row before the start is an error when the query runs."""
    end = F.when(F.col("at") < 0, F.raise_error(F.lit("samples before the start")).cast("long")).otherwise(F.col("at") + F.size("samples"))
    return signals.where("size(samples) > 0").groupBy("clip").agg(F.max(end).cast("long").alias("length"))


def _gathered(pieces: list, start: int, stop: int) -> np.ndarray:
    """The samples from start to stop, silence where there are none."""
    out = np.zeros(stop - start)
    for p in pieces:
        at, samples = int(p["at"]), np.asarray(p["samples"], np.float64)
        a, b = max(at, start), min(at + len(samples), stop)
        if a < b:
            out[a - start : b - start] += samples[a - at : b - at]
    return out


def _by_window(windows: DataFrame, kernel: Callable, schema: str, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [row for r in batch.itertuples(index=False) for row in kernel(r)]
            yield pd.DataFrame(made, columns=columns)

    return windows.mapInPandas(run, schema)


def polyphase(samples: np.ndarray, start: int, outputs: np.ndarray, up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """The given outputs, from samples that begin at place `start` and reach as far as the filter does. An output meets only the
    taps of its own phase."""
    half = len(taps) // 2
    centre = outputs * down
    first = -((half - centre) // up)  # the least input within the filter
    width = 2 * half // up + 1
    inputs = first[:, None] + np.arange(width)
    tap = centre[:, None] - inputs * up + half
    here = (tap >= 0) & (tap < len(taps)) & (inputs >= start) & (inputs < start + len(samples))
    return (np.where(here, samples[np.clip(inputs - start, 0, len(samples) - 1)], 0.0) * np.where(here, taps[np.clip(tap, 0, len(taps) - 1)], 0.0)).sum(1)


def resample(signals: DataFrame, source_rate: int, target_rate: int, window: int = WINDOW) -> DataFrame:
    """clip, at, samples at the target rate; a clip of n samples gets n * target / source, rounded half to even. Equal rates
    leave the rows as they are; clips without samples have no rows."""
    if source_rate <= 0 or target_rate <= 0:
        raise ContractError(f"no rates: {source_rate}, {target_rate}")
    if source_rate == target_rate:
        return signals.select("clip", F.col("at").cast("long").alias("at"), F.col("samples").cast("array<double>").alias("samples"))
    divisor = math.gcd(source_rate, target_rate)
    up, down = target_rate // divisor, source_rate // divisor
    taps = fir_taps(up, down)
    half = len(taps) // 2
    end = F.col("at") + F.size("samples") - 1
    first = F.expr(f"(at * {up}L - {half}L) div {down * window}L")
    last = F.floor((end * up + half) / (down * window))
    lengths = clip_lengths(signals).withColumn("length", F.rint(F.col("length") * (target_rate / source_rate)).cast("long"))

    def kernel(r) -> list[tuple]:
        outputs = np.arange(r.window * window, min((r.window + 1) * window, r.length))
        if not len(outputs):
            return []
        start, stop = (int(outputs[0]) * down - half) // up, (int(outputs[-1]) * down + half) // up + 1
        return [(r.clip, int(outputs[0]), polyphase(_gathered(r.pieces, start, stop), start, outputs, up, down, taps).tolist())]

    kind = signals.schema["clip"].dataType.simpleString()
    return _by_window(_overlapping(signals, first, last, lengths), kernel, f"clip {kind}, at long, samples array<double>", ["clip", "at", "samples"])


# --- spectrograms -----------------------------------------------------------------------------------------------------


def hertz_to_mel(hz: np.ndarray) -> np.ndarray:
    hz = np.asarray(hz, np.float64)
    above = MEL_BREAK / MEL_HZ + np.log(np.maximum(hz, MEL_BREAK) / MEL_BREAK) * MEL_STEPS / math.log(MEL_RATIO)
    return np.where(hz < MEL_BREAK, hz / MEL_HZ, above)


def mel_to_hertz(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, np.float64)
    knee = MEL_BREAK / MEL_HZ
    return np.where(mel < knee, mel * MEL_HZ, MEL_BREAK * np.exp((np.maximum(mel, knee) - knee) * math.log(MEL_RATIO) / MEL_STEPS))


def mel_filters(rate: int = RATE, n_fft: int = N_FFT, bands: int = N_MELS) -> np.ndarray:
    """Triangles between neighbouring centres, of equal area, a row a band; most entries are zero."""
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    edges = mel_to_hertz(np.linspace(0.0, float(hertz_to_mel(rate / 2)), bands + 2))
    rise = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(rise, fall)) * (2.0 / (edges[2:] - edges[:-2]))[:, None]


def _bands(power: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """power @ filters.T by the filters' entries that are not zero."""
    band, bin_ = np.nonzero(filters)
    starts = np.searchsorted(band, np.arange(len(filters)))
    there = np.diff(np.append(starts, len(band))) > 0
    out = np.zeros((len(power), len(filters)))
    if there.any():
        out[:, there] = np.add.reduceat(power[:, bin_] * filters[band, bin_], starts[there], axis=1)
    return out


def log_mel(signals: DataFrame, frames: int = FRAMES) -> DataFrame:
    """clip, frame, bands (N_MELS doubles) of clips at RATE.

    A clip gets TAIL silent samples; frames of N_FFT samples are centred HOP apart, reflected before the start, under a periodic
    Hann window, and the last one is dropped. The decimal logarithm of each band's power, LEAST at the least, is raised to the
    clip's largest less RANGE, then shifted and scaled. The largest comes from a first pass over all windows, a number each, and
    is joined to the second.
    """
    reach, filters = N_FFT // 2, mel_filters()
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    end = F.col("at") + F.size("samples") - 1
    # a frame reads from its centre less `reach` to its centre plus `reach`; the reflection ends at place `reach`, in window 0
    first = F.floor((F.col("at") - reach) / (HOP * frames))
    last = F.floor((end + reach) / (HOP * frames))
    lengths = clip_lengths(signals)
    kind = signals.schema["clip"].dataType.simpleString()

    def spectrum(r) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(r.window * frames, min((r.window + 1) * frames, (r.length + TAIL) // HOP))
        if not len(at):
            return at, np.zeros((0, N_MELS))
        start, stop = int(at[0]) * HOP - reach, int(at[-1]) * HOP + reach
        x = _gathered(r.pieces, start, max(stop, reach + 1))
        if start < 0:
            x[:-start] = x[-start + 1 : -2 * start + 1][::-1]
        rows = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[: len(at) * HOP : HOP][: len(at)]
        power = np.abs(np.fft.rfft(rows * hann, axis=1)) ** 2
        return at, np.log10(np.maximum(_bands(power, filters), LEAST))

    # windows behind the last row that TAIL reaches into are silent, but have frames
    tail = lengths.select("clip", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(((F.col("length") + TAIL) / HOP - 1) / frames))).alias("window"))
    windows = tail.join(_overlapping(signals, first, last, lengths).select("clip", "window", "pieces"), ["clip", "window"], "left")
    windows = windows.select("clip", "window", F.coalesce("pieces", F.array().cast("array<struct<at:bigint,samples:array<double>>>")).alias("pieces"), "length")

    def peak(r) -> list[tuple]:
        made = spectrum(r)[1]
        return [(r.clip, float(made.max()))] if made.size else []

    def levels(r) -> list[tuple]:
        at, made = spectrum(r)
        made = (np.maximum(made, r.peak - RANGE) + SHIFT) / SHIFT
        return [(r.clip, int(f), row) for f, row in zip(at, made.tolist(), strict=True)]

    peaks = _by_window(windows, peak, f"clip {kind}, peak double", ["clip", "peak"]).groupBy("clip").agg(F.max("peak").alias("peak"))
    return _by_window(windows.join(peaks, "clip"), levels, f"clip {kind}, frame long, bands array<double>", ["clip", "frame", "bands"])
