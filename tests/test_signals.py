"""Resampling and spectrograms against plain numpy."""

import numpy as np
import pytest

from marginalia.operators import signals
from marginalia.operators.contracts import ContractError

RNG = np.random.default_rng(7)


def pieces(spark, clips, cuts):
    """Rows of clips, each cut at the given places, in no order."""
    rows = []
    for clip, x in clips.items():
        edges = [0, *[c for c in cuts if 0 < c < len(x)], len(x)]
        rows += [(clip, a, x[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return spark.createDataFrame(rows[::-1], "clip string, at long, samples array<double>")


def whole(df, clip):
    rows = sorted((r.at, r.samples) for r in df.collect() if r.clip == clip)
    assert all(a + len(x) == b for (a, x), (b, _) in zip(rows[:-1], rows[1:], strict=True))
    return np.concatenate([x for _, x in rows])


def convolved(x, up, down, n):
    """Zeros between the samples, a direct convolution with all taps, and every down-th value."""
    taps = signals.fir_taps(up, down)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, taps)[len(taps) // 2 :]
    full = np.concatenate((full, np.zeros(n * down)))
    return full[: n * down : down]


@pytest.mark.parametrize(("source", "target"), [(44_100, 16_000), (8_000, 16_000), (48_000, 16_000), (16_000, 22_050)])
def test_resampling_is_a_convolution(spark, source, target):
    clips = {"a": RNG.normal(0, 1, 3001), "b": RNG.normal(0, 1, 1), "c": RNG.normal(0, 1, 900)}
    got = signals.resample(pieces(spark, clips, [5, 6, 400, 1300, 2999]), source, target, window=128)
    up, down = target // np.gcd(source, target), source // np.gcd(source, target)
    for clip, x in clips.items():
        n = round(len(x) * target / source)
        if n:
            assert np.abs(whole(got, clip) - convolved(x, up, down, n)).max() < 1e-9
    one = signals.resample(pieces(spark, clips, []), source, target)
    assert np.abs(whole(one, "a") - whole(got, "a")).max() < 1e-12


def test_filter_keeps_and_stops(spark):
    """Unit gain for a low tone, nothing of one above the target's band."""
    taps = signals.fir_taps(160, 441)
    assert taps.sum() == pytest.approx(160) and np.allclose(taps, taps[::-1])
    t = np.arange(4410) / 44_100
    got = signals.resample(pieces(spark, {"low": np.sin(2 * np.pi * 440 * t), "high": np.sin(2 * np.pi * 12_000 * t)}, [1000]), 44_100, 16_000)
    low = np.sin(2 * np.pi * 440 * np.arange(1600) / 16_000)
    assert np.abs(whole(got, "low") - low)[100:-100].max() < 1e-2 and np.abs(whole(got, "high"))[100:-100].max() < 2e-2


def test_equal_rates_and_errors(spark):
    df = pieces(spark, {"a": np.ones(4)}, [2])
    assert whole(signals.resample(df, 5, 5), "a").tolist() == [1.0] * 4
    with pytest.raises(ContractError):
        signals.resample(df, 0, 5)
    early = spark.createDataFrame([("a", -1, [1.0])], "clip string, at long, samples array<double>")
    with pytest.raises(Exception, match="before the start"):
        signals.resample(early, 2, 3).collect()
    assert signals.resample(df.limit(0), 2, 3).count() == 0 == signals.log_mel(df.limit(0)).count()


def spectrogram(x):
    """The definition: a plain transform of each frame, by a matrix of cosines and sines."""
    n = np.arange(400)
    x = np.concatenate((x, np.zeros(479)))
    padded = np.concatenate((x[1:201][::-1], x, np.zeros(200)))
    rows = np.stack([padded[160 * f : 160 * f + 400] for f in range((len(x)) // 160)]) * (0.5 - 0.5 * np.cos(2 * np.pi * n / 400))
    angle = 2 * np.pi * np.outer(np.arange(201), n) / 400
    power = (rows @ np.cos(angle).T) ** 2 + (rows @ np.sin(angle).T) ** 2
    logs = np.log10(np.maximum(power @ signals.mel_filters().T, 1e-10))
    return (np.maximum(logs, logs.max() - 8) + 4) / 4


def test_log_mel_by_a_plain_transform(spark):
    quiet = np.concatenate((RNG.normal(0, 1, 300), np.zeros(9000), 1e-7 * RNG.normal(0, 1, 700)))
    clips = {"noise": RNG.normal(0, 0.1, 5000), "tone": np.sin(np.arange(4000) / 9), "short": RNG.normal(0, 1, 3), "quiet": quiet}
    rows = signals.log_mel(pieces(spark, clips, [1, 150, 1601, 3000]), frames=8).collect()
    for clip, x in clips.items():
        got = {r.frame: r.bands for r in rows if r.clip == clip}
        want = spectrogram(x)
        assert sorted(got) == list(range(len(want)))
        got = np.array([got[f] for f in range(len(want))])
        assert np.abs(got - want).max() < 1e-6
        assert got.max() - got.min() <= 2 + 1e-9


def test_mel_filters():
    filters = signals.mel_filters()
    assert filters.shape == (128, 201) and (filters >= 0).all() and (filters > 0).mean() < 0.02
    assert np.allclose(signals.mel_to_hertz(signals.hertz_to_mel([0, 500, 1000, 4000.0])), [0, 500, 1000, 4000])
    power = RNG.random((5, 201))
    assert np.allclose(signals._bands(power, filters), power @ filters.T)
