"""Lineage cuts that survive a lost executor.

``cut`` writes a table below the folder that the cluster names in ``spark.checkpoint.dir`` and reads it back.
Only where that setting is absent and the master is local (tests, single machine) a folder of our own is made.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import DataFrame, SparkSession



#: What a worker process holds from task to task, by name. Task functions travel by value and so would carry copies of it:
#: they must reach it through the functions of this module.
_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What this process holds by that name, made where it isn't there."""
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def drop_held(keeps: str = "") -> None:
    for name in [n for n in _HELD if n != keeps]:
        del _HELD[name]


def give_back() -> None:
    """Returns freed memory to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """A task function for ``mapInArrow`` that is careful with a worker's memory, as workers are kept for later tasks.

    It drops what other functions' tasks have left behind, but for the name ``keeps``, and gives freed memory back at the end."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        drop_held(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


_MADE: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        at = "file://" + tempfile.mkdtemp(prefix="tracesift-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return the reread table."""
    spark = df.sparkSession
    at = f"{root(spark)}/tracesift-{uuid.uuid4().hex}"
    _MADE.append((spark, at))
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def release() -> None:
    """Delete all tables made by ``cut``; results that still read them must be consumed before."""
    while _MADE:
        spark, at = _MADE.pop()
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session is gone, and with it the way to reach the folder
            return


atexit.register(release)
