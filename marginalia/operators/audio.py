"""Re-rendering of mixtures: sources, onsets, gains, ordered accumulation, corrections, encoding and digests.

A manifest's rows are joined with their sources (stems of a tuple, substitutes by design, or other tuples' stems) as DataFrames.
The order of the float additions is part of the result (a digest is checked), so mixing is a Python kernel, a view at a time in
Arrow batches.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import bit_mask, design_id
from marginalia.operators.contracts import ContractError

RATE = 16_000
FULL_SCALE = 32767
# fixed values: seconds of lead, of stagger, of a clip and of a view; each event's bit in a stem's name; the panels
LEAD, STAGGER, CLIP_SECONDS, VIEW_SECONDS = 1.0, 0.75, 2.0, 4.0
EVENT_BITS = (1, 2, 4)
COPIED_PANELS = ("absent", "prompt", "fixed")


def _rivals(indices: Column, target: Column) -> Column:
    return F.filter(indices, lambda i: i != target)


def onsets(overlap: Column, y_present: Column, target: Column, indices: Column, rate: Column) -> Column:
    """Map of source index to the frame where it begins: all after the lead if they overlap in full; else the target does, and the
    two rivals STAGGER earlier and later, the first one earlier where the present answer is A. There is no place for a third rival,
    which is an error when the query runs."""
    lead = F.floor(LEAD * rate)
    first = F.when(y_present == "A", -1).otherwise(1)

    def at(i: Column) -> Column:
        third = F.raise_error(F.concat(F.lit("no onset for rival "), i.cast("string"))).cast("int")
        place = F.array_position(_rivals(indices, target), i)
        sign = F.when(place == 1, first).when(place == 2, -first).otherwise(third)
        return F.when((overlap == "full") | (i == target), lead).otherwise(F.floor((LEAD + STAGGER * sign) * rate)).cast("long")

    return F.map_from_arrays(indices, F.transform(indices, at))


def gains(target: Column, indices: Column, target_gain: Column, rival_gain: Column) -> Column:
    """Map of source index to gain."""
    return F.map_from_arrays(indices, F.transform(indices, lambda i: F.when(i == target, target_gain).otherwise(rival_gain).cast("double")))


def mix(sources: list[tuple[int, np.ndarray, int, float]], frames: int, omitted: int | None = None) -> np.ndarray:
    """Sum of sources (index, samples, onset, gain) but the omitted one, in their order; a source that runs past the end is an error."""
    out = np.zeros(frames)
    for index, samples, at, gain in sources:
        if index == omitted:
            continue
        if at < 0 or at + len(samples) > frames:
            raise ValueError(f"source {index}: {len(samples)} samples from {at} on do not fit {frames} frames")
        out[at : at + len(samples)] += gain * samples
    return out


def corrected(mixed: np.ndarray, *factors: float | None) -> np.ndarray:
    """A view's corrections in their order; a factor of exactly 1, or none, is no multiplication, which keeps the float bits."""
    for factor in factors:
        if factor is not None and factor == factor and factor != 1.0:
            mixed = mixed * factor
    return mixed


def encode(samples: np.ndarray, rate: int = RATE) -> bytes:
    """Mono 16-bit WAV: clipped to [-1, 1], rounded half to even."""
    data = np.rint(np.clip(samples, -1.0, 1.0) * FULL_SCALE).astype("<i2").tobytes()
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(data)
    return buffer.getvalue()


def centre_crop(samples: np.ndarray, seconds: float = CLIP_SECONDS, rate: int = RATE) -> np.ndarray:
    n = int(seconds * rate)
    at = max(0, (len(samples) - n) // 2)
    return samples[at : at + n]


def source_clip(samples: np.ndarray, common_gain: float, rate: int = RATE) -> np.ndarray:
    """A stem as it was before the gain it was stored with, cropped to its middle two seconds."""
    return centre_crop(samples, rate=rate) / common_gain


def envelope(samples: np.ndarray, segments: int = 120) -> np.ndarray:
    return np.array([np.abs(x).max() if len(x) else 0.0 for x in np.array_split(samples, segments)])


def render(views: DataFrame) -> DataFrame:
    """path, content, sha256 of rows (path, rate, sources array<struct<index, samples, onset, gain>>, removed_index,
    normalization_gain, shared_safety_gain, audio_sha256); a digest that is given and differs is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, rate, sources, removed, normal, safety, expected in zip(*(batch[c] for c in _VIEW), strict=True):
                omitted = None if removed is None or removed != removed else int(removed)
                own = [(int(s["index"]), np.array(s["samples"]), int(s["onset"]), float(s["gain"])) for s in sources]
                content = encode(corrected(mix(own, int(VIEW_SECONDS * rate), omitted), normal, safety), int(rate))
                out.append((path, content, _checked(path, content, expected)))
            yield pd.DataFrame(out, columns=["path", "content", "sha256"])

    return views.select(*_VIEW).mapInPandas(run, "path string, content binary, sha256 string")


_VIEW = ("path", "rate", "sources", "removed_index", "normalization_gain", "shared_safety_gain", "audio_sha256")


def _checked(path: str, content: bytes, expected: str | None) -> str:
    digest = hashlib.sha256(content).hexdigest()
    if expected and expected != digest:
        raise ValueError(f"{path}: digest {digest}, expected {expected}")
    return digest


# --- panels -----------------------------------------------------------------------------------------------------------


def stem_ref(tuple_id: Column, event: Column) -> Column:
    """The file of a tuple's event by itself."""
    bits = F.element_at(F.array(*map(F.lit, EVENT_BITS)), event.cast("int") + 1)
    return F.concat(F.lit("audio_sources/stems/"), tuple_id, F.lit("/subset_"), bit_mask(bits), F.lit(".wav"))


def events_of(panel: str, manifest: DataFrame, design: DataFrame | None = None) -> DataFrame:
    """condition_id, index, ref, scale (null: a stem, cropped and without its gain) of each event of a synthesised panel.

    subst takes the target's sound from the design (rid, substitute_ref, rms_scale) by the condition's name before its level; a
    condition without a design row is an error. repair has its events in repair_target and repair_distractors.
    """
    part = lambda tuple_id, event: F.struct(stem_ref(tuple_id, event).alias("ref"), F.lit(None).cast("double").alias("scale"))
    if panel == "repair":
        listed = F.concat(F.array("repair_target"), "repair_distractors")
        made = F.transform(listed, lambda e: part(e[0], e[1].cast("int")))
        return manifest.select("condition_id", F.posexplode(made).alias("index", "e")).select("condition_id", "index", "e.ref", "e.scale")
    stems = F.array(*[part(F.col("source_tuple_id"), F.lit(i)) for i in range(len(EVENT_BITS))])
    rows = manifest.select("condition_id", "target_index", F.posexplode(stems).alias("index", "e")).select("condition_id", "target_index", "index", "e.ref", "e.scale")
    if panel == "subst":
        by = design.select(F.col("rid").alias("_rid"), "substitute_ref", "rms_scale")
        rows = rows.withColumn("_rid", design_id(F.col("condition_id"))).join(by, "_rid", "left")
        is_target = F.col("index") == F.col("target_index")
        missing = F.raise_error(F.concat(F.lit("no design row for "), F.col("condition_id")))
        ref = F.when(is_target, F.coalesce("substitute_ref", missing.cast("string"))).otherwise(F.col("ref"))
        rows = rows.withColumns({"ref": ref, "scale": F.when(is_target, F.col("rms_scale"))})
    return rows.select("condition_id", "index", "ref", "scale")


def assert_one_rate(clips: DataFrame) -> int:
    """The clips' common rate; several are an error."""
    low, high = clips.agg(F.min("rate"), F.max("rate")).first()
    if low is None or low != high:
        raise ContractError(f"clips have no common rate: {low} to {high}")
    return int(low)


def event_samples(events: DataFrame, clips: DataFrame, index: DataFrame) -> DataFrame:
    """condition_id, index, samples of events_of, from clips (ref, rate, samples) and the sources' index (ref,
    common_constituent_gain). Each clip is prepared once, whatever number of conditions has it; one that is missing is an error."""
    wanted = events.select("ref", "scale").distinct().join(clips.select("ref", "rate", "samples"), "ref", "left")
    wanted = wanted.join(index.select("ref", F.col("common_constituent_gain").alias("gain")), "ref", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ref, scale, rate, samples, gain in zip(*(batch[c] for c in ("ref", "scale", "rate", "samples", "gain")), strict=True):
                stem = scale is None or scale != scale
                if samples is None or stem and (gain is None or gain != gain):
                    raise FileNotFoundError(f"{ref}: no {'clip' if samples is None else 'gain'}")
                out.append((ref, None if stem else scale, (source_clip(np.array(samples), gain, int(rate)) if stem else np.array(samples) * scale).tolist()))
            yield pd.DataFrame(out, columns=["ref", "scale", "samples"])

    made = wanted.select("ref", "scale", "rate", "samples", "gain").mapInPandas(run, "ref string, scale double, samples array<double>")
    same = (F.col("e.ref") == F.col("m.ref")) & F.col("e.scale").eqNullSafe(F.col("m.scale"))
    return events.alias("e").join(made.alias("m"), same).select("e.condition_id", "e.index", "m.samples")


def render_panel(panel: str, manifest: DataFrame, clips: DataFrame, index: DataFrame, design: DataFrame | None = None) -> DataFrame:
    """path, content, sha256 of all views of a synthesised panel's manifest; digests are checked."""
    rate = assert_one_rate(clips)
    samples = event_samples(events_of(panel, manifest, design), clips, index)
    held = samples.groupBy("condition_id").agg(F.map_from_entries(F.collect_list(F.struct("index", "samples"))).alias("events"))
    included, target = F.col("included_indices"), F.col("target_index")
    rows = manifest.withColumn("onsets", onsets(F.col("overlap"), F.col("y_present"), target, included, F.lit(rate)))
    rows = rows.withColumn("gains", gains(target, included, F.col("target_gain"), F.col("distractor_gain"))).join(held, "condition_id")
    source = lambda i: F.named_struct(F.lit("index"), i, F.lit("samples"), F.element_at("events", i), F.lit("onset"), F.element_at("onsets", i), F.lit("gain"), F.element_at("gains", i))
    rows = rows.select(F.transform(included, source).alias("sources"), F.inline("views")).withColumn("rate", F.lit(rate)).withColumnRenamed("audio", "path")
    return render(rows)


def copy_panel(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, content, sha256 of all views of a panel that is copied, from files (ref, content); a missing file, or one with another
    digest than its view's, is an error when the query runs."""
    views = manifest.select(F.inline("views")).select(F.col("audio").alias("path"), "audio_sha256")
    held = views.join(files.select(F.col("ref").alias("_ref"), "content"), F.concat(F.lit("audio_sources/"), F.col("path")) == F.col("_ref"), "left")
    digest = F.sha2("content", 256)
    wrong = F.raise_error(F.concat(F.col("path"), F.lit(": no file, or another digest")))
    right = F.when(F.col("content").isNotNull() & (F.col("audio_sha256").isNull() | (digest == F.col("audio_sha256"))), digest)
    return held.select("path", "content", F.coalesce(right, wrong.cast("string")).alias("sha256"))
