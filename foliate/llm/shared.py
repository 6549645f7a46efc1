"""What the operators of this subpackage share: the folder all executors see, files in it, and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import shutil
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that separate words: space and 0x09 to 0x0D. bytes.split() and bytes.strip() use this very set.
WHITESPACE = b" \t\n\r\x0b\x0c"

#: Rows of an Arrow batch, where rows hold texts or sets and where they hold a few numbers.
BATCH_ROWS, WIDE, NARROW = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000, 10_000

#: Bytes and rows of a row group in tables that workers write.
GROUP_BYTES, GROUP_ROWS = 8 << 20, 1 << 17

#: Used only where the session names no spark.checkpoint.dir, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach, from spark.checkpoint.dir; a cluster must name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors can reach")
    return folder or LOCAL_CHECKPOINTS


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it holds, Arrow batches have so many rows at most, since Spark bounds them by rows alone, not by bytes."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def cut(frame: DataFrame, batch: int = WIDE) -> DataFrame:
    """frame, computed once and kept in the shared folder: later steps read it there, also after an executor is lost."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    with batches_of(spark, batch):
        return frame.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own for one job's files, below the shared folder; made when its first file is written."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, path: str, batch: int = WIDE) -> DataFrame:
    """frame written as a compressed table below the shared folder, and read from there."""
    with batches_of(frame.sparkSession, batch):
        frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a job's folder, in whatever store it is, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The frames that the job under way has kept.
JOB: ContextVar[list[DataFrame] | None] = ContextVar("JOB", default=None)


@contextmanager
def job() -> Iterator[None]:
    """Tables kept while it holds are there until its end at least, and go with the last reference to their frames."""
    token = JOB.set([])
    try:
        yield
    finally:
        JOB.reset(token)


def mapped(frame: DataFrame, run: Callable, schema: str) -> DataFrame:
    """frame.mapInArrow of run, which `kept` lets the same worker write down that computes it."""
    made = frame.mapInArrow(tidy(run), schema)
    made._made_by = (frame, run)
    return made


def kept(frame: DataFrame, batch: int = WIDE, stay: bool = False) -> DataFrame:
    """frame, computed once and kept as a table of the shared folder: later steps read it there, also after an executor is
    lost. Outside of a job, and if it is to stay, until the driver ends.

    On a local (or mounted) folder the Python workers write it. Spark's own writers start `chmod` there several times for each
    file; each time a child shares all memory of the executor's JVM for a moment, and what sums up the memory of an executor's
    processes sees that twice. Other stores get it from Spark's writer.
    """
    spark = frame.sparkSession
    path = new_folder(spark, "kept")
    local = path.startswith(("/", "file:"))
    if local:
        system, folder = file_system(path)
        system.create_dir(folder, recursive=True)
        source, run = vars(frame).get("_made_by", (frame, None))
        with batches_of(spark, batch):
            source.mapInArrow(tidy(_writing(path, run, frame.schema)), "nothing long").write.format("noop").mode("overwrite").save()
        made = spark.read.schema(frame.schema).parquet(path)
        remove = lambda: shutil.rmtree(folder, ignore_errors=True)
    else:
        made = stored(frame, path, batch)
        remove = lambda: remove_folder(spark, path)
    held = JOB.get()
    if held is not None and not stay:
        held.append(made)
        weakref.finalize(made, remove).atexit = local
    elif local:
        weakref.finalize(spark.sparkContext, remove)
    return made


def _writing(path: str, run: Callable | None, schema: StructType) -> Callable:
    """A function of batches that writes them, or what run makes of them, to a Parquet file of the task's partition, whole or
    not at all and under the same name each time, so a task may run twice. Without rows there is no file. Files are as large
    as their rows, since Spark takes small files for tables to broadcast."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = pa.schema([field.with_nullable(True) for field in to_arrow_schema(schema)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet
        from pyspark import TaskContext

        system, folder = file_system(path)
        name = f"{TaskContext.get().partitionId():05}.parquet"
        draft, writer = f"{folder}/.{name}.{uuid.uuid4().hex}", None
        try:
            for group in _row_groups(run(batches) if run else batches, fields):
                writer = writer or parquet.ParquetWriter(draft, fields, filesystem=system, compression="none", use_dictionary=False)
                writer.write_table(group)
            if writer:
                writer.close()
                system.move(draft, f"{folder}/{name}")
                writer = None
        finally:
            if writer:
                writer.close()
                system.delete_file(draft)
        yield from ()

    return write


def _row_groups(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.Table]:
    held, size, rows = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]).select(fields.names).cast(fields))
            size, rows = size + held[-1].nbytes, rows + batch.num_rows
        if size > GROUP_BYTES or rows > GROUP_ROWS:
            yield pa.concat_tables(held)
            held, size, rows = [], 0, 0
    if held:
        yield pa.concat_tables(held)


def file_system(uri: str):
    """(file system, path in it) of a folder or file in any store that pyarrow can reach."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[5:] if not uri.startswith("file://") else uri[7:]
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, parts: list[bytes]) -> str:
    """Writes folder/name whole or not at all: under a name of its own first, then renamed, so a task may run twice."""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    system.move(draft, f"{path}/{name}")
    return f"{folder}/{name}"


def read_file(uri: str) -> bytes:
    system, path = file_system(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()


def free_name(columns: list[str]) -> str:
    """A column name that a table of these columns hasn't got."""
    return max(map(str.lower, columns), key=len, default="") + "_"


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of doc_id written as decimal text, modulo divisor; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def about(key: Column, most: int, total: int) -> Column:
    """Whether a row belongs to a sample of about `most` of `total` rows, by the hash of its key: no sort, no limit."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(min(1 << 30, (most << 30) // max(total, 1)))


def step_of(value: Column, steps: int = 32) -> Column:
    """A bucket for an integer of 0 or more: exact below 2 * steps, then `steps` (a power of two) for each doubling."""
    shift = F.greatest(F.length(F.bin(value)) - steps.bit_length(), F.lit(0))
    return (shift * steps + F.call_function("shiftright", value, shift.cast("int"))).cast("int")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (with a column n) of the largest n, `most` at most: equal steps of n stay or go together.

    Only a histogram of about 2,000 steps reaches the driver, however many tasks there are.
    """
    steps = sorted(((r.step, r.least, r.rows) for r in counts.groupBy(step_of(F.col("n")).alias("step")).agg(F.min("n").alias("least"), F.count("*").alias("rows")).collect()), reverse=True)
    room, least = most, None
    for _, low, rows in steps:
        if rows > room:
            break
        room, least = room - rows, low
    return counts.filter(F.lit(False) if least is None else F.col("n") >= least)


#: What makes a worker forget what it keeps from task to task; modules that keep something add theirs.
FORGET: list[Callable[[], None]] = []


def tidy(run: Callable, keep: bool = False) -> Callable:
    """run, a function of batches for mapInArrow, so that a worker gives memory back when a task of it ends: Spark keeps
    workers from task to task, and what one has freed would else count as its own for good. Unless `keep`, the worker first
    drops what tasks of other operators have kept there for their next one."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from foliate.llm.shared import FORGET  # the worker's own

        for forget in () if keep else FORGET:
            forget()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def rows_of(batches: Iterator[pa.RecordBatch], most: int, weight: str | None = None, heavy: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batches cut so that none has more than `most` rows or, in column `weight`, much over `heavy` bytes (one row at least)."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            stop = min(start + most, batch.num_rows)
            if weight:
                while stop - start > 1 and batch.column(weight).slice(start, stop - start).nbytes > heavy and _bytes(batch, weight, start, stop) > heavy:
                    stop = start + (stop - start) // 2
            yield batch.slice(start, stop - start)
            start = stop


def _bytes(batch: pa.RecordBatch, column: str, start: int, stop: int) -> int:
    import pyarrow.compute as pc

    return pc.sum(pc.binary_length(batch.column(column).slice(start, stop - start))).as_py() or 0
