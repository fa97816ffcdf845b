"""Resampling, spectrograms and frame counts over signals made from the events: SIGNAL values in order of event_id are a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import signals, tokens
from marginalia.plans.base import query
from marginalia.plans.proxy import table

S = SparkSession
#: Samples of a clip, and of a row of it.
SIGNAL, STRETCH = 4000, 250
SOURCE_RATE, TARGET_RATE = 24_000, 16_000


def event_signals(spark: S, d: str) -> DataFrame:
    """clip, at, samples."""
    rows = table(spark, d, "events").select("event_id", F.coalesce("value", F.lit(0.0)).cast("double").alias("value"))
    place = F.pmod("event_id", F.lit(SIGNAL))
    rows = rows.select(F.expr(f"event_id div {SIGNAL}").alias("clip"), (place - place % STRETCH).alias("at"), F.struct("event_id", "value").alias("x"))
    return rows.groupBy("clip", "at").agg(F.sort_array(F.collect_list("x"))["value"].alias("samples"))


_SIGNALS = f"""
WITH samples AS (SELECT event_id // {SIGNAL} AS clip, event_id % {SIGNAL} AS k, coalesce(value, 0) AS x FROM events),
lengths AS (SELECT clip, max(k) + 1 AS length FROM samples GROUP BY clip)
"""


def _resampled_sql() -> str:
    up, down = 2, 3
    taps = [float(x) for x in signals.fir_taps(up, down)]
    half = len(taps) // 2
    return _SIGNALS + f""", outputs AS (SELECT clip, unnest(range(round_even(length * {TARGET_RATE / SOURCE_RATE!r}, 0)::BIGINT)) AS n FROM lengths)
SELECT o.clip, o.n, round(sum(x * ({taps})[n * {down} - k * {up} + {half} + 1]), 6) + 0.0 AS y
FROM outputs o JOIN samples s ON s.clip = o.clip AND k * {up} BETWEEN n * {down} - {half} AND n * {down} + {half} GROUP BY o.clip, o.n"""


@query(_resampled_sql(), cte=False)
def resampled(spark: S, d: str) -> DataFrame:
    made = signals.resample(event_signals(spark, d), SOURCE_RATE, TARGET_RATE)
    rows = made.select("clip", "at", F.posexplode("samples").alias("i", "y"))
    return rows.select("clip", (F.col("at") + F.col("i")).alias("n"), (F.round("y", 6) + 0.0).alias("y"))


def _mel_sql() -> str:
    filters = signals.mel_filters()
    entries = ", ".join(f"({b}, {k}, {float(filters[b, k])!r})" for b, k in zip(*filters.nonzero(), strict=True))
    n, hop, half = signals.N_FFT, signals.HOP, signals.N_FFT // 2
    return _SIGNALS + f""", frames AS (SELECT clip, unnest(range((length + {signals.TAIL}) // {hop})) AS frame FROM lengths),
places AS (SELECT unnest(range({n})) AS i),
windowed AS (
  SELECT f.clip, frame, i, x * (0.5 - 0.5 * cos(2 * pi() * i / {n})) AS v
  FROM frames f, places JOIN samples s ON s.clip = f.clip AND k = abs(frame * {hop} + i - {half})
), spectrum AS (
  SELECT clip, frame, bin, power(sum(v * cos(2 * pi() * (bin * i % {n}) / {n})), 2) + power(sum(v * sin(2 * pi() * (bin * i % {n}) / {n})), 2) AS p
  FROM windowed, (SELECT unnest(range({half + 1})) AS bin) GROUP BY clip, frame, bin
), filters(band, bin, w) AS (VALUES {entries}),
bands AS (SELECT unnest(range({signals.N_MELS})) AS band),
logs AS (
  SELECT f.clip, f.frame, b.band, log10(greatest(coalesce(sum(w * p), 0), {signals.LEAST})) AS v
  FROM frames f CROSS JOIN bands b LEFT JOIN filters w ON w.band = b.band LEFT JOIN spectrum s ON s.clip = f.clip AND s.frame = f.frame AND s.bin = w.bin
  GROUP BY f.clip, f.frame, b.band
)
SELECT clip, frame, band, round((greatest(v, max(v) OVER (PARTITION BY clip) - {signals.RANGE}) + {signals.SHIFT}) / {signals.SHIFT}, 6) AS level FROM logs"""


@query(_mel_sql(), cte=False)
def mel_levels(spark: S, d: str) -> DataFrame:
    rows = signals.log_mel(event_signals(spark, d)).select("clip", "frame", F.posexplode("bands").alias("band", "level"))
    return rows.select("clip", "frame", F.col("band").cast("long").alias("band"), F.round("level", 6).alias("level"))


@query(f"SELECT doc_id, n_chars::BIGINT AS n_frames, {tokens.token_count_sql('n_chars')}::BIGINT AS n_tokens FROM documents WHERE n_chars >= {tokens.LEAST_FRAMES}", cte=False)
def token_counts(spark: S, d: str) -> DataFrame:
    """A text's characters taken as the frames of a spectrogram."""
    rows = table(spark, d, "documents").where(F.col("n_chars") >= tokens.LEAST_FRAMES)
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_frames"), tokens.token_count("n_chars").alias("n_tokens"))
