"""Small helpers shared by the operators: durable tables, bounded broadcasts, batch maps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two numbers up to which a side of a join may be broadcast (some 16 MB).
BROADCAST_ROWS = 1_000_000
#: Arrow bytes of the rows that a map function turns into Python objects at once.
LOT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return context.getCheckpointDir()


def durable(frame: DataFrame) -> DataFrame:
    """``frame`` computed once and kept in the work folder, with no lineage."""
    work_folder(frame.sparkSession)
    return frame.checkpoint()


def small(frame: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if its counted rows stay within the bound, else left to Spark's join."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


#: Caches of a Python worker that must not outlive the task that filled it; a reused worker would
#: otherwise carry them from stage to stage.
TASK_CACHES: list = []


def task_cache(cache):
    """Register ``cache`` (anything with ``clear``) to be emptied when a task's map function ends."""
    TASK_CACHES.append(cache)
    return cache


def end_of_task() -> None:
    """Empty the registered caches and hand freed Arrow and C heap memory back to the system."""
    for cache in TASK_CACHES:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:  # glibc only; elsewhere freed memory stays with the process
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lots(batches: Iterator[pa.RecordBatch], most: int = LOT_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows in their order, in slices of at most ``most`` bytes or of one row.

    A batch has 10,000 rows unless the session says otherwise, so its texts as Python objects, and
    what is made of them, would take many times the memory of a slice.
    """
    for batch in batches:
        rows = batch.num_rows
        if rows > 1 and batch.nbytes > most:
            yield from lots(iter((batch.slice(0, rows // 2), batch.slice(rows // 2))), most)
        else:
            yield batch


def task_scoped(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A map function over ``lots`` of Arrow batches that calls ``end_of_task`` when it ends."""

    def scoped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(lots(batches))
        finally:
            end_of_task()

    return scoped


def no_null(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def map_columns(frame: DataFrame, schema: str, work: Callable[..., dict]) -> DataFrame:
    """``work(column lists...)`` per Arrow batch, giving a dict of the columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string(schema)
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                made = work(*(column.to_pylist() for column in batch.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[field.name], field.type) for field in arrow], schema=arrow
                )
        finally:
            end_of_task()

    return frame.mapInArrow(run, wanted)


def filter_rows(frame: DataFrame, columns: list[str], keep: Callable[..., list[bool]]) -> DataFrame:
    """Rows for which ``keep(column lists...)`` says so; all columns pass through untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in lots(batches):
                mask = keep(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))
                yield batch.filter(pa.array(mask, pa.bool_()))
        finally:
            end_of_task()

    return frame.mapInArrow(run, frame.schema)
