"""Small session helpers: local result rows, shared folder, staging of small inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablegauge.functions.nulls import quoted

# Inputs whose estimated size is below this are cached for the several passes of a profile.
STAGE_BYTES = 512 * 1024 * 1024


def local_rows(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A DataFrame of a few computed rows (one per column, say), planned as a local relation."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [() for _ in schema]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(v), type=f.type) for v, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


_own_dir: list[str] = []  # the folder made by this process where the session names none


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Unset, it is a folder of this machine in local mode
    and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tablegauge-"))
        base = _own_dir[0]
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, fixed in the shared folder: later reads see exactly these."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, fixed in the shared folder as a checkpoint does, but as compressed columns: a fraction of its size."""
    if any(kind in df.schema.simpleString() for kind in ("void", "interval")):  # not for Parquet
        return checkpointed(df)
    path, plain = fresh_path(df.sparkSession, name), df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.schema(plain.schema).parquet(path)
    return rows.select([F.col(f"c{i}").alias(f.name, metadata=f.metadata) for i, f in enumerate(df.schema)])


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan; file sizes for a scan, products for a join."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


@contextmanager
def staged(df: DataFrame, limit: int = STAGE_BYTES):
    """The same rows, cached over all cores if they are known to be small.

    A profile reads its input several times. A large input is read again each time, with only
    the columns of the pass; a small one is spread and kept, which saves opening files again.
    """
    size = estimated_bytes(df)
    if size > limit:
        yield df
        return
    # About a megabyte per partition: a small input must not become a task per core of a cluster.
    parts = min(df.sparkSession.sparkContext.defaultParallelism, max(4, size // 2**20))
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # By a hash of the row: spreading without a key would sort all rows first.
    key = F.xxhash64(*[quoted(c) for c in hashable]) if hashable else F.lit(0)
    kept = df.repartition(int(parts), key).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def together(jobs: list[Callable]) -> list:
    """Results of independent Spark jobs, submitted at the same time."""
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]
