"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.storage import dropped, looked_up, shared_folder, stored

__all__ = ["CLEAN", "ascii_lower", "checkpointed", "dropped", "let", "looked_up", "ready_for_checkpoints", "settings", "shared_folder", "space_words", "stored", "table", "text_or_empty", "worker_cache"]

#: ASCII white space, as the contracts of the operators define it.
SPACES = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, also within lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def space_words(text: Column) -> Column:
    """Words as runs of anything but ASCII white space."""
    flat = F.translate(text, SPACES, " " * len(SPACES))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ready_for_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


#: Shuffle files go as soon as the action that wrote them has ended.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the actions within."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpointed(df: DataFrame, partitions: int, key: str) -> DataFrame:
    """``df`` in partitions by ``key``, checkpointed so that later groupings by the key need no shuffle.

    An adaptive plan doesn't tell its partitioning, so the plan of this one action is not adaptive.
    """
    with settings(df.sparkSession, {**CLEAN, "spark.sql.adaptive.enabled": "false"}):
        return df.repartition(partitions, key).checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_worker: tuple[str, Any] | None = None


def worker_cache(owner: str, make: Callable[[], Any] = dict) -> Any:
    """What an operator keeps in a Python worker between its tasks.

    Spark gives one worker to task after task, of whatever operator. What another one has left is
    dropped first, so that a worker holds the cache of one operator at most.
    """
    global _worker
    if _worker is None or _worker[0] != owner:
        _worker = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        _worker = (owner, make())
    return _worker[1]
