"""Session settings and shared storage used by every operator."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Folders that the innermost scratch() has written and that nothing has kept.
_written: ContextVar[dict[str, SparkSession] | None] = ContextVar("written", default=None)


def local_session(cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; a cluster brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName("ledgerflow").config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or else one beside the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run. It also gives both sides of a
    later join a plain exchange, so that adaptive execution can split a hot key.
    """
    return _stored(df, df, tag)


def measured(df: DataFrame, tag: str, only: str | None = None, **sums: str) -> tuple[DataFrame, dict]:
    """As materialize(), with SQL aggregates of the rows that come from the job that writes them; of these it writes ``only`` some, if told."""
    seen = Observation()
    watched = df.observe(seen, *[F.expr(x).alias(name) for name, x in sums.items()])
    return _stored(df, watched.where(only) if only else watched, tag), seen.get


def _stored(df: DataFrame, watched: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerflow/{uuid.uuid4().hex}-{tag}"
    watched.write.parquet(path)
    if (written := _written.get()) is not None:
        written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def keep(table: DataFrame) -> DataFrame:
    """Let a table that materialize() gave outlive the scratch() that it was written in; an outer scratch() then owns it."""
    if (written := _written.get()) is not None:
        written[table.stored_at] = None
    return table


@contextmanager
def scratch() -> Iterator[None]:
    """Delete what materialize() writes in this block when the block ends well, but for what keep() was told of.

    After an error everything stays, to be looked at. Inside another scratch(), kept tables pass to that one.
    """
    outer, own = _written.get(), {}
    token = _written.set(own)
    try:
        yield
    finally:
        _written.reset(token)
    for path, spark in own.items():
        if spark is not None:
            _delete(spark, path)
        elif outer is not None:
            outer[path] = SparkSession.getActiveSession()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
