"""Where jobs keep written intermediates, and how they cut lineage."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_program: list[tuple[SparkSession, str]] = []
#: Whose intermediates are made now; a thread (the live job's handler, say) has a scope of its own.
_scope: ContextVar[list[tuple[SparkSession, str]]] = ContextVar("scope", default=_program)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the warehouse
    (which is shared by definition) where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; nothing is created yet.

    The path belongs to the block of ``temporary`` it is made in, in this thread, or else to the program, and is
    deleted when that ends.
    """
    path = f"{shared_root(spark)}/riskloom/{purpose}-{uuid.uuid4().hex}"
    _scope.get().append((spark, path))
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Intermediates that this thread makes inside are deleted at the end; results must be written by then."""
    mine: list[tuple[SparkSession, str]] = []
    outer = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(outer)
        _delete(mine)


def release() -> None:
    """Delete the program's intermediates; frames that read them end with it."""
    _delete(_program)


def _delete(paths: list[tuple[SparkSession, str]]) -> None:
    while paths:
        delete(*paths.pop())


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session ended first: the folder's retention rule remains
        pass


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where several actions read one derived table. Unlike a cache, the
    files survive the loss of any executor.
    """
    path = workspace(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grown(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, and so is never broadcast, for which it would pass through the driver.

    Spark guesses the size of a few columns from files in which mostly NULL columns weigh nothing, and
    keeps a broadcast that it planned by such a guess.
    """
    return side.hint("merge")


def tidy(spark: SparkSession) -> None:
    """Let shuffle files of finished steps go now: Spark drops them when the driver's
    garbage is collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative jobs cut lineage; a configured folder is already in use."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(f"{shared_root(spark)}/riskloom/checkpoints")
