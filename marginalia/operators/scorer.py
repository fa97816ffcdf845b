"""The scorer protocol: label log-probabilities of a view, behind mapInPandas. Models are not shipped; a mock is.

A scorer has score_logprobs(view, labels, *, question) -> {label: logp}; score or score_view, with or without the question,
will do. It is made once in each worker.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame


class MockScorer:
    """Scores from a table by view name or payload, or from a function."""

    def __init__(self, source: Mapping | Callable):
        self.source = source

    def score_logprobs(self, view: str, labels: Sequence[str], *, question: str | None = None) -> dict[str, float]:
        made = self.source(view, labels, question) if callable(self.source) else self.source[view]
        return normal_scores(made, labels)


def normal_scores(scores: Mapping | Sequence, labels: Sequence[str]) -> dict[str, float]:
    """A finite number for each label, from a mapping or a sequence in the labels' order; no labels are an error."""
    if not len(labels):
        raise ValueError("no labels to score")
    if not isinstance(scores, Mapping):
        if len(scores) != len(labels):
            raise ValueError(f"{len(scores)} scores for {len(labels)} labels")
        scores = dict(zip(labels, scores, strict=True))
    if missing := [x for x in labels if x not in scores]:
        raise KeyError(f"no score for {missing}")
    out = {x: float(scores[x]) for x in labels}
    if bad := [x for x, v in out.items() if not math.isfinite(v)]:
        raise ValueError(f"scores are not finite for {bad}")
    return out


def call(scorer, view: str, labels: Sequence[str], question: str | None) -> dict[str, float]:
    method = next((m for m in (getattr(scorer, n, None) for n in ("score_logprobs", "score", "score_view")) if m), None)
    if method is None:
        raise TypeError(f"{type(scorer).__name__} has no scoring method")
    parameters = inspect.signature(method).parameters
    takes = "question" in parameters or any(p.kind is p.VAR_KEYWORD for p in parameters.values())
    return normal_scores(method(view, labels, question=question) if takes else method(view, labels), labels)


def score_views(views: DataFrame, make: Callable[[], object]) -> DataFrame:
    """views (condition_id, intervention, audio, question, y_present, y_absent) with logp_present, logp_absent, margin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for batch in batches:
            scorer = scorer or make()
            made = [call(scorer, v, [a, b], q) for v, a, b, q in zip(batch["audio"], batch["y_present"], batch["y_absent"], batch["question"], strict=True)]
            present = [m[a] for m, a in zip(made, batch["y_present"], strict=True)]
            absent = [m[b] for m, b in zip(made, batch["y_absent"], strict=True)]
            yield pd.DataFrame({"condition_id": batch["condition_id"], "intervention": batch["intervention"], "logp_present": present, "logp_absent": absent, "margin": [a - b for a, b in zip(present, absent, strict=True)]})

    return views.mapInPandas(run, "condition_id string, intervention string, logp_present double, logp_absent double, margin double")
