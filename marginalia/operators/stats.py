"""Rates, correlations, agreement, standardisation and quantiles as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.ranks import below, numbered_twice


def ordinal_rank(value: Column | str, ties: list[Column | str], partition: list[str] | None = None) -> Column:
    """Rank by sorted place; ties are told apart by the columns given."""
    w = Window.partitionBy(*(partition or [])).orderBy(value, *ties)
    return F.row_number().over(w).cast("long")


def average_rank(value: Column | str, partition: list[str] | None = None) -> Column:
    """Rank with ties averaged."""
    v = F.col(value) if isinstance(value, str) else value
    own = partition or []
    ties = F.count("*").over(Window.partitionBy(*own, v))
    return F.rank().over(Window.partitionBy(*own).orderBy(v)) + (ties - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """rho by group: average ranks, or ordinal ones if `ties` names the columns that decide."""
    by = by or []
    if ties:
        ranked = df.withColumn("_x", ordinal_rank(x, ties, by)).withColumn("_y", ordinal_rank(y, ties, by))
    else:
        ranked = df.withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    return ranked.groupBy(*by).agg(F.corr(F.col("_x").cast("double"), F.col("_y").cast("double")).alias("rho"), F.count("*").alias("n"))


def value_places(df: DataFrame, value: str, by: list[str], buckets: int | None = None) -> DataFrame:
    """by, value, n, below, total: how many rows of the group have the value, how many a smaller one, and how many rows it has. Rows
    are counted by value first; then the different values are placed in ranges, so no window holds those of a group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return below(counts, F.col(value), F.col("n"), by, "below", buckets, "total")


def spearman_of_units(df: DataFrame, x: str, y: str, by: list[str], ties: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """spearman() for tables that grow with the data: average ranks come from value_places, ordinal ones from numbered ranges."""
    if ties:
        ranked = numbered_twice(df, {"_x": [x, *ties], "_y": [y, *ties]}, by, buckets).withColumns({c: F.col(c) + 1.0 for c in ("_x", "_y")})
        return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))
    ranked = df
    for c, rank in ((x, "_x"), (y, "_y")):
        places = value_places(df, c, by, buckets).withColumnsRenamed({"n": "_n", "below": "_below"})
        ranked = ranked.join(places, [*by, c]).withColumn(rank, F.col("_below") + (F.col("_n") + 1) / 2.0).drop("_n", "_below", "total")
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def quantiles(df: DataFrame, value: str, by: list[str], shares: dict[str, Column | float], buckets: int | None = None) -> DataFrame:
    """Exact quantiles, interpolated linearly, by group: a column for each share, which may itself be a column that is constant
    in df. Nulls do not count."""
    carried = {k: v for k, v in shares.items() if isinstance(v, Column)}
    own = df.where(F.col(value).isNotNull()).select(*by, value, *[v.alias(f"_q_{k}") for k, v in carried.items()])
    constant = [f"_q_{k}" for k in carried]
    placed = value_places(own, value, [*by, *constant], buckets).withColumn("_last", F.col("total") - 1)
    made = []
    for k, v in shares.items():
        at = (F.col(f"_q_{k}") if k in carried else F.lit(v)) * F.col("_last")
        value_at = lambda i: F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("n")), F.col(value)))
        lo, part = value_at(F.floor(at)), F.max(at - F.floor(at))
        made.append((lo + (value_at(F.ceil(at)) - lo) * part).alias(k))
    return placed.groupBy(*by).agg(*made)


def cohen_kappa(df: DataFrame, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """Agreement of two predicates beyond chance, in one aggregation."""
    x, y = a.cast("double"), b.cast("double")
    sums = df.groupBy(*(by or [])).agg(F.avg((a == b).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"), F.count("*").alias("n"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return sums.withColumn("pe", pe).withColumn("kappa", F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe"))).drop("pa", "pb")


def transitions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, share: the contingency table and each row's shares."""
    counts = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def mix(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def near_equal_groups(df: DataFrame, order: list[Column], groups: int = 5, alias: str = "quintile") -> DataFrame:
    """Groups in order, sizes differing by one at most, the larger first. For dimension tables: one task orders them."""
    return df.withColumn(alias, F.ntile(groups).over(Window.orderBy(*order)).cast("long"))


def standardised_delta(treated: DataFrame, control: DataFrame, cell: list[str], fail: str, ok: str, least_units: int = 3) -> DataFrame:
    """Sum of fail - ok * the control cell's rate, over ok, in cells with enough control units."""
    cells = control.groupBy(*cell).agg(F.sum(fail).alias("_f"), F.sum(ok).alias("_n"), F.count("*").alias("_units"))
    cells = cells.where((F.col("_n") > 0) & (F.col("_units") >= least_units)).withColumn("_rate", F.col("_f") / F.col("_n"))
    joined = treated.where(F.col(ok) > 0).join(cells, cell)
    sums = joined.agg(F.sum(F.col(fail) - F.col(ok) * F.col("_rate")).alias("num"), F.coalesce(F.sum(ok), F.lit(0)).cast("long").alias("den"), F.count("*").alias("n_units"))
    return sums.select(F.try_divide("num", F.col("den").cast("double")).alias("delta"), "den", "n_units")


def swept(df: DataFrame, name: str, values: tuple[float, ...]) -> DataFrame:
    """df once for each value of a short constant list: no join, an explode of a literal."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
