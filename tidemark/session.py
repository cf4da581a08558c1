"""Session helpers: where intermediate tables live and how they are written."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP = 16 << 20  # bytes of an intermediate table that a writing task holds
_LOCAL_DIRS: dict[str, str] = {}


class _Made:
    """Paths of the tables written in the innermost ``disposable`` block.

    Functions sent to tasks take the globals they name along; a context variable cannot travel, and tasks
    need no list, so there this arrives empty.
    """

    def __init__(self):
        self.now: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tables made", default=None)

    def __reduce__(self):
        return _Made, ()


_MADE = _Made()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session, where
    every task sees the same disk, may fall back to a temporary folder, which goes with the process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage, freezes non-deterministic columns and survives the
    loss of executors; later readers still get column pruning and pushdown.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{work_dir(spark)}/{app}/{label}-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    made = _MADE.now.get()
    if made is not None:
        made.append(path)
    return out


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What a job shuffled is deleted when it ends, not when the driver next collects garbage; no other job reads it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and nothing reads any more."""
    _delete(df.sparkSession, df.written_to)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def disposable(spark: SparkSession) -> Iterator:
    """Tables that ``materialise`` writes inside go at the end, but for those passed to the function it gives.

    What leaves the block must read kept tables only.  After a failure the tables stay, for a look at them.
    """
    outer, made = _MADE.now.get(), []

    def keep(df: DataFrame) -> DataFrame:
        made.remove(df.written_to)
        if outer is not None:
            outer.append(df.written_to)
        return df

    token = _MADE.now.set(made)
    try:
        yield keep
    finally:
        _MADE.now.reset(token)
    for path in made:
        _delete(spark, path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand at most ``rows`` rows at once to Python, for rows that are long; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions for shuffles that feed Python work.

    Given explicitly, they are not merged by adaptive execution, which judges by
    bytes and would put compute-heavy small tables into one task.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
