"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH = "tidewatt.local.scratch"
# Shuffle files of a query go when it ends, and not when the driver collects its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class _Owner:
    """What a job has put into the shared folder."""

    paths: list[str] = field(default_factory=list)
    checkpoints: bool = False


_OWNED = "owned-checkpoints"
_owner: ContextVar[_Owner | None] = ContextVar("tidewatt_scratch_owner", default=None)


def prepare_session(spark: SparkSession) -> SparkSession:
    """All time arithmetic is done on UTC wall-clock time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a temporary
    folder. On a cluster a machine-local folder would be lost with its
    machine, so there a missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = spark.conf.get(_LOCAL_SCRATCH, None)
    if root is None:
        root = tempfile.mkdtemp(prefix="tidewatt-")
        spark.conf.set(_LOCAL_SCRATCH, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder; nothing is created yet."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    owner = _owner.get()
    if owner is not None:
        owner.paths.append(path)
    return path


@contextmanager
def owned_scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, whatever is staged or checkpointed inside.

    For jobs whose results are written or collected before the end: tables
    that read staged ones can't be used afterwards. Scopes may be nested; the
    staged tables of a failed job are removed too.
    """
    owner = _Owner()
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)
        outer = _owner.get()
        if outer is not None:
            outer.checkpoints = False  # the folder set last is gone; the next cut names another
        for path in owner.paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark can write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and restart its lineage from reliable storage."""
    spark = df.sparkSession
    owner, folder = _owner.get(), spark.sparkContext.getCheckpointDir()
    if owner is not None and not owner.checkpoints:
        owner.checkpoints = True
        spark.sparkContext.setCheckpointDir(scratch_path(spark, _OWNED))
    elif owner is None and (folder is None or f"/{_OWNED}-" in folder):
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)


def stage(df: DataFrame, label: str = "stage", by: Sequence[str] = (), parts: int = 0) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Used for tables that several later passes read: each pass then prunes
    columns and skips row groups, and survives the loss of any executor. With
    ``by`` rows are dealt by these columns into ``parts`` files, and Spark knows
    it: what groups or joins by them afterwards shuffles none of these rows.
    """
    return _staged(df, scratch_path(df.sparkSession, label), by, parts)


@contextmanager
def staged(df: DataFrame, label: str = "stage", by: Sequence[str] = (), parts: int = 0) -> Iterator[DataFrame]:
    """``stage`` for passes that end inside; the table is removed after them."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    try:
        yield _staged(df, path, by, parts)
    finally:
        remove(spark, path)


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; its results don't need them any more."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def _staged(df: DataFrame, path: str, by: Sequence[str], parts: int) -> DataFrame:
    spark = df.sparkSession
    if not by:
        with _freeing_shuffles(spark):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    # only tables of the catalogue can be dealt out; the name goes at once, files and plan stay
    name = f"tidewatt_{uuid.uuid4().hex}"
    with _freeing_shuffles(spark):
        dealt = df.repartition(parts, *by).write.bucketBy(parts, *by).format("parquet")
        dealt.option("path", path).option("compression", "zstd").saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
