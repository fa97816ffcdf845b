"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch sent to Python: whole texts travel, so batches stay short.
BATCH_ROWS = 1000
_local_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; a smaller setting of the session is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests),
    and an error on a cluster, whose machines share no such folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="marginalia-"))
    return _local_scratch[0]


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/marginalia/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, df: DataFrame) -> str:
    """A column name like this one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys that hold over 1 / HUBS of a join's rows are joined apart; there are fewer than HUBS of them, however large the join.
HUBS = 1000


def join_hubs(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined with facts (one row a key; the column `weight`, which goes, says how many rows have the key) where `total` is
    at least the number of rows. Keys that hold over total / HUBS rows are broadcast, fewer than HUBS rows of facts, so no key
    gathers more than that share in a task; the others are dealt out by key."""
    heavy = F.col(weight) * HUBS > total
    hubs = F.broadcast(facts.where(heavy).drop(weight))
    light = rows.join(F.broadcast(facts.where(heavy).select(key)), key, "left_anti").join(facts.where(~heavy).drop(weight), key)
    return rows.join(hubs, key).unionByName(light)
