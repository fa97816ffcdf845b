"""Synthetic detectors over stem energies: what a detector of known behaviour scores on each view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import metrics as M

FLOOR_SHARE = 1e-3


def surviving(units: DataFrame, floor_share: float = FLOOR_SHARE) -> DataFrame:
    """A row for each unit and view, of (unit_id, included_indices, target_index, stem_rms, view_total_rms): the floor, the
    target's energy, the rivals' energies. stem_rms has text keys; views are full, remove_target and the unit's remove_off_*.
    """
    stems = F.transform_keys("stem_rms", lambda k, v: k.cast("int"))
    peak = F.array_max(F.map_values("stem_rms"))
    floor = F.lit(floor_share) * F.when(peak == 0, 1.0).otherwise(peak)
    offs = F.filter(F.map_keys("view_total_rms"), lambda k: k.startswith("remove_off_"))
    rows = units.select("unit_id", "included_indices", "target_index", stems.alias("stems"), floor.alias("floor"), F.explode(F.concat(F.array(F.lit("full"), F.lit("remove_target")), F.array_sort(offs))).alias("view"))
    removed = F.when(F.col("view").startswith("remove_off_"), F.regexp_extract("view", r"_([^_]*)$", 1).cast("int"))
    rows = rows.withColumn("removed", removed)
    target = F.when((F.col("view") == "remove_target") | (F.col("removed") == F.col("target_index")), 0.0).otherwise(F.element_at("stems", F.col("target_index")))
    rivals = F.transform(F.filter("included_indices", lambda i: (i != F.col("target_index")) & ~i.eqNullSafe(F.col("removed"))), lambda i: F.element_at(F.col("stems"), i))
    return rows.select("unit_id", "view", "floor", target.alias("target"), rivals.alias("rivals"))


def detectors(additive: tuple[float, ...] = (0.5, 1.0, 2.0), normalize: tuple[float, ...] = (1.0, 10.0)) -> dict[str, Callable[[Column, Column, Column], Column]]:
    """name -> score of (floor, target, rivals)."""
    most = lambda r: F.coalesce(F.array_max(r), F.lit(0.0))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x)
    log = lambda f, z: F.log1p(F.greatest(z, F.lit(0.0)) / f)
    out = {"oracle": lambda f, t, r: log(f, t), "shortcut": lambda f, t, r: log(f, most(r)), "loudness": lambda f, t, r: log(f, t + total(r))}
    out |= {f"additive_a{a}": lambda f, t, r, a=a: log(f, t) - a * log(f, most(r)) for a in additive}
    return out | {f"normalize_c{c}": lambda f, t, r, c=c: t / (f + c * most(r)) for c in normalize}


def probe_summary(units: DataFrame, floor_share: float = FLOOR_SHARE) -> DataFrame:
    """probe, n_correct, rankfail and the share of each state."""
    rows = surviving(units, floor_share)
    scored = rows.select("unit_id", "view", F.inline(F.array(*[F.struct(F.lit(k).alias("probe"), f(F.col("floor"), F.col("target"), F.col("rivals")).alias("score")) for k, f in detectors().items()])))
    from marginalia.operators.units import pivot_views

    wide = pivot_views(scored, ["probe", "unit_id"], value="score").where(M.usable()).withColumn("state", M.state())
    ok = M.correct()
    return wide.groupBy("probe").agg(F.count_if(ok).alias("n_correct"), M.share(M.failure(), ok).alias("rankfail"), *[M.share(F.col("state") == s, ok).alias(s) for s in M.STATES])
