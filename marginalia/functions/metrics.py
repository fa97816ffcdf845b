"""Column expressions over a unit: its full margin mf, the margin mt with the target removed, and its rivals' margins.

Rivals enter through their least and largest margin only, so units carry mj_min, mj_max and n_rivals and everything stays in
generated code. Predicates are exact: an ordering tie (h = 0) is a failure, a margin of 0 is no correct answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATES = ("ungrounded", "confused", "context", "grounded")
#: Dead bands and thresholds that are reported.
THRESHOLDS = (-1.0, -0.5, 0.0, 0.5, 1.0, 2.0)
BANDS = (0.125, 0.25, 0.5, 1.0)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def margin(present: Column | str = "logp_present", absent: Column | str = "logp_absent") -> Column:
    return _c(present) - _c(absent)


def finite(x: Column | str) -> Column:
    """Neither null nor NaN nor infinite. (Spark's least() passes over NaN and null, which would hide them.)"""
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def usable(mf="mf", mt="mt", mj_min="mj_min", mj_max="mj_max", n_rivals="n_rivals") -> Column:
    return finite(mf) & finite(mt) & finite(mj_min) & finite(mj_max) & (_c(n_rivals) > 0)


def correct(tau: float | Column = 0.0) -> Column:
    return F.col("mf") > tau


def dt() -> Column:
    return F.col("mf") - F.col("mt")


def max_dj() -> Column:
    return F.col("mf") - F.col("mj_min")


def max_abs_dj() -> Column:
    return F.greatest(F.col("mf") - F.col("mj_min"), F.col("mj_max") - F.col("mf"))


def h() -> Column:
    return F.least("mf", "mj_min") - F.col("mt")


def h_difference_form() -> Column:
    """Equal to h() in real numbers; in floating point only for margins on a grid."""
    return dt() - F.greatest(F.lit(0.0), max_dj())


def g() -> Column:
    return dt() - max_abs_dj()


def ordered_wrong() -> Column:
    """Comparison form, exact for any floats."""
    return F.least("mf", "mj_min") <= F.col("mt")


def failure(tau: float | Column = 0.0) -> Column:
    return correct(tau) & ordered_wrong()


def ungrounded() -> Column:
    return failure() & (F.col("mf") <= F.col("mt"))


def confused() -> Column:
    return failure() & (F.col("mf") > F.col("mt"))


def state() -> Column:
    """Null for an incorrect unit; otherwise the first condition that holds."""
    return (
        F.when(~correct(), None).when(dt() <= 0, STATES[0]).when(ordered_wrong(), STATES[1]).when(g() <= 0, STATES[2]).otherwise(STATES[3])
    )


def printed_conditions() -> Column:
    """How many of the four printed conditions hold (they overlap)."""
    parts = (dt() <= 0, (dt() > 0) & (h() <= 0), (dt() > 0) & (g() <= 0), (h() > 0) & (g() > 0))
    return sum((p.cast("long") for p in parts[1:]), parts[0].cast("long"))


def answer_flip() -> Column:
    return correct() & ((F.col("mt") > 0) | (F.col("mj_min") <= 0))


def target_only_alarm() -> Column:
    return correct() & (dt() <= 0)


def target_removed_alarm() -> Column:
    return correct() & (F.col("mt") > 0)


def tie_credit(m: Column | str) -> Column:
    m = _c(m)
    return F.when(m > 0, 1.0).when(m == 0, 0.5).otherwise(0.0)


def half_even_bin(x: Column | str, width: float = 0.5) -> Column:
    return F.bround(_c(x) / width, 0) * width


def share(num: Column, den: Column) -> Column:
    """Rows with num and den over rows with den; null without any."""
    return F.try_divide(F.count_if(num & den).cast("double"), F.count_if(den).cast("double"))
