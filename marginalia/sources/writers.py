"""Sinks: JSON results and lines, macro and table files, content-addressed and run-manifest output."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.sources.readers import few_rows


def json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines with sorted keys; with an order, rows are in it over all files by name."""
    rows = df.select(*sorted(df.columns))
    (rows.orderBy(*order) if order else rows).write.mode("errorifexists").json(path)


def json_result(df: DataFrame, path: str) -> None:
    """A small result table (readers.MOST_ROWS rows at most) as one indented document."""
    rows = [json.loads(r["value"]) for r in few_rows(df.select(F.to_json(F.struct("*")).alias("value")), "the result")]
    with open(path, "w") as f:
        json.dump(rows, f, indent=1, ensure_ascii=False)


def macro_lines(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Definitions of (name, value) rows; a name with anything but letters is an error."""
    bad = df.where(~F.col(name).rlike("^[A-Za-z]+$")).limit(1).collect()
    if bad:
        raise ValueError(f"no macro name: {bad[0][name]}")
    return df.select(F.concat(F.lit("\\newcommand{\\"), F.col(name), F.lit("}{"), F.col(value), F.lit("}")).alias("value"))


def macro_file(df: DataFrame, path: str) -> None:
    macro_lines(df).coalesce(1).write.mode("overwrite").text(path)


def table_rows(df: DataFrame, columns: list[str]) -> str:
    """Body lines of a LaTeX table (readers.MOST_ROWS at most), in the rows' order."""
    escape = lambda x: re.sub(r"([&%_#$])", r"\\\1", str(x))
    return "\n".join(" & ".join(escape(r[c]) for c in columns) + r" \\" for r in few_rows(df.select(*columns), "the table"))


def addressed(rows: DataFrame, root: str, verify_existing: bool = False) -> DataFrame:
    """Write (path, content, sha256) rows below root; path, state. Existing files are an error, or must have the digest.

    For a folder that all executors share."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            states = []
            for path, content, digest in zip(batch["path"], batch["content"], batch["sha256"], strict=True):
                if hashlib.sha256(content).hexdigest() != digest:
                    raise ValueError(f"{path}: content has another digest")
                to = os.path.join(root, path)
                if os.path.exists(to):
                    with open(to, "rb") as f:
                        held = hashlib.sha256(f.read()).hexdigest()
                    if not verify_existing or held != digest:
                        raise FileExistsError(to)
                    states.append("verified")
                    continue
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(f"{to}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f"{to}.{os.getpid()}", to)
                states.append("written")
            yield pd.DataFrame({"path": batch["path"], "state": states})

    return rows.select("path", "content", "sha256").mapInPandas(run, "path string, state string")


class RunManifest:
    """Steps with their result, seconds and digests of what they read and wrote."""

    def __init__(self) -> None:
        self.steps: list[dict] = []

    @staticmethod
    def _digests(paths: tuple[str, ...]) -> dict[str, str]:
        out = {}
        for p in paths:
            if os.path.isfile(p):
                with open(p, "rb") as f:
                    out[p] = hashlib.file_digest(f, "sha256").hexdigest()
        return out

    def step(self, name: str, run, outputs: tuple[str, ...] = (), inputs: tuple[str, ...] = ()):
        began, code, read = time.time(), 1, self._digests(inputs)
        try:
            result = run()
            code = 0
            return result
        finally:
            self.steps.append({"step": name, "code": code, "seconds": round(time.time() - began, 3), "inputs": read, "outputs": self._digests(outputs)})

    def write(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.steps, f, indent=1)
