"""Data contracts: eager checks that raise, each at the cost of one aggregation."""

from __future__ import annotations

import ast
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(AssertionError):
    pass


@dataclass
class Registry:
    """What has been verified, in order."""

    verified: list[str] = field(default_factory=list)

    def passed(self, label: str) -> None:
        self.verified.append(label)

    def report(self) -> str:
        return "\n".join(f"ok {x}" for x in self.verified)


REGISTRY = Registry()


def assert_total(observed: int, expected: int, label: str, registry: Registry = REGISTRY) -> int:
    if observed != expected:
        raise ContractError(f"{label}: {observed:,} observed, {expected:,} expected ({observed - expected:+,})")
    registry.passed(label)
    return observed


def sum_matches(parts, total: int) -> bool:
    values = list(parts.values()) if isinstance(parts, dict) else list(parts)
    return all(isinstance(v, int) and not isinstance(v, bool) and v >= 0 for v in values) and sum(values) == total


def assert_partition(parts, total: int, label: str, registry: Registry = REGISTRY) -> None:
    """Whole, non-negative parts that sum to the total; a truth value is no count."""
    values = list(parts.values()) if isinstance(parts, dict) else list(parts)
    if any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in values):
        raise ContractError(f"{label}: parts must be whole and not negative: {parts}")
    if sum(values) != total:
        raise ContractError(f"{label}: parts sum to {sum(values):,}, total is {total:,} ({sum(values) - total:+,})")
    registry.passed(label)


def assert_same_total(a: int, b: int, label: str, registry: Registry = REGISTRY) -> None:
    assert_total(a, b, label, registry)


def assert_design(df: DataFrame, expected: dict[str, int], label: str, registry: Registry = REGISTRY) -> None:
    """A design's cardinalities: rows, and <column> different values of a column, as expected says ({"rows": 1536, "model": 8})."""
    made = [(F.count("*") if k == "rows" else F.count_distinct(k)).alias(k) for k in expected]
    found = df.agg(*made).first().asDict()
    if found != expected:
        raise ContractError(f"{label}: {found} found, {expected} expected")
    registry.passed(label)


def assert_group_size(df: DataFrame, keys: list[str], size: int, label: str, registry: Registry = REGISTRY) -> None:
    """Every group has exactly so many rows."""
    odd = df.groupBy(*keys).count().where(F.col("count") != size).limit(3).collect()
    if odd:
        raise ContractError(f"{label}: groups of {size} expected, e.g. {[r.asDict() for r in odd]}")
    registry.passed(label)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def bucket_unique(df: DataFrame, keys: list[str], label: str, registry: Registry = REGISTRY) -> DataFrame:
    """df, if no key stands twice."""
    found = duplicate_keys(df, keys).limit(3).collect()
    if found:
        raise ContractError(f"{label}: {', '.join(keys)} is no key, e.g. {[r.asDict() for r in found]}")
    registry.passed(label)
    return df


def bucket_multi(df: DataFrame, keys: list[str], label: str, registry: Registry = REGISTRY) -> DataFrame:
    """Counts by key, after a proof that no row is lost."""
    counts = df.groupBy(*keys).count()
    assert_total(counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0], df.count(), label, registry)
    return counts


def assert_bounds(df: DataFrame, column: str, low, high, label: str, registry: Registry = REGISTRY) -> None:
    outside = df.where(~F.col(column).between(low, high)).limit(1).collect()
    if outside:
        raise ContractError(f"{label}: {outside[0].asDict()} is not within {low} to {high}")
    registry.passed(label)


def coverage(seen: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """side, n: keys that only one side has. No rows in either is equality of sets."""
    extra = seen.select(*keys).distinct().join(expected, keys, "left_anti").agg(F.count("*").alias("n"))
    missing = expected.select(*keys).distinct().join(seen, keys, "left_anti").agg(F.count("*").alias("n"))
    return extra.select(F.lit("extra").alias("side"), "n").unionByName(missing.select(F.lit("missing").alias("side"), "n"))


def assert_coverage(seen: DataFrame, expected: DataFrame, keys: list[str], label: str, registry: Registry = REGISTRY) -> None:
    found = {r["side"]: r["n"] for r in coverage(seen, expected, keys).collect()}
    if any(found.values()):
        raise ContractError(f"{label}: {found}")
    registry.passed(label)


def assert_agree(a: DataFrame, b: DataFrame, keys: list[str], value: str, label: str, registry: Registry = REGISTRY) -> None:
    """Two result tables say the same of each key; a key that one lacks is fatal."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    found = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).limit(3).collect()
    if found:
        raise ContractError(f"{label}: {[r.asDict() for r in found]}")
    registry.passed(label)


def agrees_where_both(a: Column, b: Column) -> Column:
    """Optional fields: equal, or one is not there."""
    return F.coalesce(a == b, F.lit(True))


def checksum_mismatches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """path, sha256, expected of binary files (path, content) that differ from the list (path, sha256) or are on one side only."""
    got = files.select("path", F.sha2("content", 256).alias("sha256"))
    both = got.join(expected.select("path", F.col("sha256").alias("expected")), "path", "full_outer")
    return both.where(~F.col("sha256").eqNullSafe(F.col("expected")))


#: Folders of a release that are made, not shipped.
MADE = frozenset(("generated", "logs", "__pycache__", ".git", ".venv", "outputs", "rendered", "checkpoints"))


def tree_problems(root: str, made: frozenset[str] = MADE) -> list[tuple[str, str]]:
    """path, problem of symbolic links, and of Python files that do not parse, below a folder on the driver (release_problems
    looks into files, which Spark reads; links are known to the file system only)."""
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in made)
        for name in sorted([*names, *folders]):
            path = os.path.join(folder, name)
            if os.path.islink(path):
                found.append((os.path.relpath(path, root), "symbolic link"))
            elif name.endswith(".py") and os.path.isfile(path):
                try:
                    with open(path, "rb") as f:
                        ast.parse(f.read())
                except (SyntaxError, ValueError):
                    found.append((os.path.relpath(path, root), "syntax"))
    return found


def release_problems(files: DataFrame, sensitive: Column, most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """path, problem: oversized files and files whose text matches `sensitive` (a predicate over the column text)."""
    checked = files.withColumn("text", F.col("content").cast("string"))
    problem = F.when(F.col("length") >= most_bytes, "oversized").when(sensitive, "sensitive pattern")
    return checked.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())
