"""Scans of JSON lines, JSON documents, indexed score files, macro files and WAV."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.contracts import bucket_unique


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines, gzipped or not by the file's name; blank lines are passed over, broken ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, rows: str, schema: str) -> DataFrame:
    """The objects of one array inside whole-file documents, e.g. rows = "panels.baseline" or "units"."""
    parts = rows.split(".")
    nested = f"array<struct<{_as_fields(schema)}>>"
    for part in reversed(parts[1:]):
        nested = f"struct<{part}:{nested}>"
    df = spark.read.schema(f"{parts[0]} {nested}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.select(F.inline(F.col(rows)))


def _as_fields(ddl: str) -> str:
    out, depth = [], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        out.append(c)
    text, fields, start, depth = "".join(out), [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = text[start:i].strip().split(None, 1)
            fields.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(fields)


def score_index(spark: SparkSession, path: str) -> DataFrame:
    from marginalia.sources.schemas import SCORE_INDEX

    return spark.read.schema(SCORE_INDEX).option("multiLine", True).json(path)


#: Rows that may come to the driver: an index's, a result document's, a printed table's.
MOST_ROWS = 100_000


def few_rows(df: DataFrame, what: str, most: int | None = None) -> list:
    """The rows of a table that is small by contract; a larger one is an error, and no more than its size's bound comes here."""
    most = MOST_ROWS if most is None else most
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has over {most} rows")
    return rows


def indexed_scores(spark: SparkSession, root: str, index: DataFrame, schema: str) -> DataFrame:
    """All score files of an index in one scan, with panel and model from the index: a row a file, MOST_ROWS at most."""
    entries = few_rows(index.select("panel", "model", "file"), "the index")
    df = json_lines(spark, [f"{root}/{r['file']}" for r in entries], schema)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    by = spark.createDataFrame([(*r["file"].split("/")[-2:], r["panel"], r["model"]) for r in entries], "_folder string, _name string, panel string, model string")
    return df.withColumn("_name", name).withColumn("_folder", folder).join(F.broadcast(by), ["_folder", "_name"]).drop("_folder", "_name")


_kept: dict[tuple, DataFrame] = {}


def _keep(key: tuple, make) -> DataFrame:
    if key not in _kept:
        _kept[key] = make().persist()
    return _kept[key]


def release_kept() -> None:
    """Let go of all scans that are kept for several uses."""
    while _kept:
        _kept.popitem()[1].unpersist()


def panel_scores(spark: SparkSession, root: str, index: DataFrame, panel: str, model: str, schema: str) -> DataFrame:
    """One panel's and model's scores, read once and kept for several uses, until release_kept()."""
    own = index.where((F.col("panel") == panel) & (F.col("model") == model))
    return _keep((spark, root, panel, model, schema), lambda: indexed_scores(spark, root, own, schema))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A panel's manifest, read once and kept for several uses, until release_kept()."""
    from marginalia.sources.schemas import MANIFEST

    return _keep((spark, path), lambda: json_lines(spark, path, MANIFEST))


def keyed_lookup(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """JSON lines whose key must be unique (silent last-wins is not offered)."""
    return bucket_unique(json_lines(spark, path, schema), [key], f"{path}: {key}")


def macros(spark: SparkSession, path: str) -> DataFrame:
    """name, value of the macro definitions in text files."""
    return parse_macros(spark.read.text(path), "value")


def parse_macros(lines: DataFrame, column: str) -> DataFrame:
    pattern = r"^\\newcommand\{\\([A-Za-z0-9]+)\}\{(.*)\}\s*$"
    found = lines.where(F.col(column).rlike(pattern))
    return found.select(F.regexp_extract(column, pattern, 1).alias("name"), F.regexp_extract(column, pattern, 2).alias("value"))


def decode_wav(content: bytes, scale: int | None = None, mono16: bool = False) -> tuple[int, np.ndarray]:
    """Rate and mono samples. 8, 16 or 32 bits, channels averaged, divided by `scale` (2^(bits-1) if none)."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if mono16 and (width, channels) != (2, 1):
        raise ValueError(f"not mono 16-bit PCM: {channels} channels, {8 * width} bits")
    kinds = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}
    if width not in kinds:
        raise ValueError(f"{8 * width}-bit samples")
    x = np.frombuffer(raw, kinds[width]).astype(np.float64) - (128 if width == 1 else 0)
    return rate, x.reshape(-1, channels).mean(1) / (scale or 1 << 8 * width - 1)


def wav_files(spark: SparkSession, path: str, scale: int | None = None, mono16: bool = False) -> DataFrame:
    """path, rate, samples of WAV files. scale 32767 with mono16 reads as the renderer does, 32768 as figures do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [decode_wav(c, scale, mono16) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "rate": [r for r, _ in made], "samples": [x.tolist() for _, x in made]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<double>")
