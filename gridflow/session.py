"""Session helpers: the shared work folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BROADCAST_BYTES = 64 << 20
_written: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a local session that names none gets a temporary folder, which ends with the process.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="gridflow-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/gridflow-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage without tying the data to the executors that made it, and
    pins results whose plan is expensive or is read several times.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Paths of the tables that `stored` has written and nobody released, in order."""
    return list(_written)


def release(spark: SparkSession, paths: list[str], *in_use: DataFrame) -> list[str]:
    """Delete tables that `stored` has written, but for those that `in_use` reads; returns the latter's paths.

    For runs whose results are written: what made an earlier result is not needed any more.
    """
    read, kept = [f for df in in_use for f in df.inputFiles()], []
    for path in paths:
        if any(f"/{path.rstrip('/').rsplit('/', 1)[-1]}/" in f for f in read):
            kept.append(path)
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(path)
    return kept


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True when `df` is proven to hold at most `limit` bytes of `row_bytes` rows.

    Stops counting just above the bound, so the check does not scan a large table.
    """
    max_rows = max(1, limit // max(1, row_bytes))
    return df.limit(max_rows + 1).count() <= max_rows


def in_threads(tasks: list, parallelism: int) -> list:
    """Run independent fits at the same time; Spark interleaves their stages."""
    if parallelism <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]
