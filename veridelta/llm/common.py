"""What the operators of this subpackage share: scratch space, tables and text rows."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.session import checkpointed, shared_dir, written

__all__ = ["checkpointed", "given_back", "kept", "read", "shared_dir", "short_shuffles", "slices", "small_batches", "whole_text", "written"]

#: Bytes of rows that go to a worker at once, about; by default Spark sends up to 10,000 rows or 64 MB.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(column, size: int = 256):
    """A long Arrow string column as lists of at most ``size`` Python strings."""
    for at in range(0, len(column), size):
        yield at, column.slice(at, size).to_pylist()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL(None).malloc_trim(0)


#: What this worker keeps between tasks: of one step at a time.
_KEPT: dict[Hashable, object] = {}


def kept(name: Hashable, make: Callable):
    """What ``make`` gives, made once a worker and kept between tasks until another ``name`` is asked for.

    Workers live on for the tasks of later steps; what several steps keep would add up in an executor."""
    if name not in _KEPT:
        let_go()
        _KEPT[name] = make()
    return _KEPT[name]


def let_go() -> None:
    """Drops what this worker keeps for a step."""
    if _KEPT:
        _KEPT.clear()
        _give_back()


def small_batches(spark: SparkSession) -> None:
    """Rows go to workers in batches of about ``BATCH_BYTES``, unless the session says otherwise.

    A batch is held by the executor, outside its heap, and by the worker, with room to grow; rows may be whole texts or sets."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def short_shuffles(spark: SparkSession) -> None:
    """A query's shuffle files go when it ends, unless the session says otherwise.

    By default they stay until the driver happens to collect its garbage; a stage of many queries would leave several times its
    input on the executors' disks, the more the larger the driver's memory."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, True)


def given_back(f, keeps: bool = False):
    """``f`` of batches, after which its worker gives free memory back to the system; before, what it keeps for other steps,
    unless ``f`` itself ``keeps`` something.

    Workers live on for the tasks of later steps; what each step's batches once took would add up in an executor."""

    @functools.wraps(f)
    def of(batches):
        if not keeps:
            let_go()
        try:
            yield from f(batches)
        finally:
            _give_back()

    return of
