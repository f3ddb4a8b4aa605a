"""Shared plumbing of the training-data operators.

Three conventions hold everywhere here:

* texts are read through Arrow batches (``mapInArrow``): one batch in memory per task;
* lineage is cut with tables written under the folder named by ``spark.checkpoint.dir``,
  which the driver and every executor share, so a lost executor only repeats its tasks;
* a null text counts as the empty text.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweft.session import import_path

CHECKPOINT = "spark.checkpoint.dir"
OWN_FOLDER = "lakeweft.shared.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT = "67108864b"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    Only where the setting is unset and one machine does all the work (tests) a local one is
    made and remembered; on a cluster each executor would write to its own disk.
    """
    folder = spark.conf.get(CHECKPOINT, None) or spark.conf.get(OWN_FOLDER, None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT} to a folder that the driver and every executor share")
        folder = "file://" + tempfile.mkdtemp(prefix="lakeweft-")
        spark.conf.set(OWN_FOLDER, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of this run alone, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/lakeweft/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table.  At exit the JVM may be gone first; then its folder stays behind."""
    jvm_context = spark.sparkContext._jsc
    if jvm_context is None:
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jvm_context.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except (Py4JError, OSError):  # the JVM went first
        pass


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a worker's memory doesn't grow with the length of texts.

    Only the default is lowered; a value of the user's own stays.  Workers are also told where this package is.
    """
    import_path(spark)
    if spark.conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, "4m")


#: Deletes a query's shuffle files as soon as it ends; Spark itself waits until its driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written in each open ``scratch``.
_SCRATCH: list[list[DataFrame]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back."""
    spark = df.sparkSession
    bounded(spark)
    path = new_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeweft_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables written inside at its end, but for those passed to the function it gives."""
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    _SCRATCH.append([])
    try:
        yield keep
    finally:
        inside = _SCRATCH.pop()
    for table in inside:
        if not any(table is k for k in kept):
            drop_written(table)
    if _SCRATCH:
        _SCRATCH[-1].extend(kept)


def drop_written(df: DataFrame) -> None:
    remove(df.sparkSession, df._lakeweft_path)


def free_name(base: str, taken: list[str]) -> str:
    """A column name that isn't taken, whatever the case of letters."""
    low, name = {t.lower() for t in taken}, f"__{base}"
    while name in low:
        name += "_"
    return name


#: What Python workers keep between tasks: (function that drops it, modules that use it).
_KEPT: list[tuple[Callable[[], None], tuple[str, ...]]] = []
_last_module = ""


def keeps(drop: Callable[[], None], *modules: str) -> None:
    """Say that workers keep something for tasks of these modules, and how it is dropped."""
    _KEPT.append((drop, modules))


def begin_task(module: str) -> None:
    """Called by a task: what other operators kept in this worker is dropped, and freed memory goes back to the system.

    Workers outlive an operator, so without this their memory would be the sum of all operators'.
    """
    global _last_module
    if module != _last_module:
        for drop, users in _KEPT:
            if module not in users:
                drop()
        gc.collect()
        _last_module = module
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Texts are handed to an operator in slices of about this many bytes, at least one text each.
SLICE_BYTES = 1 << 20


def sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE_BYTES of text, so that word lists of a whole batch never exist at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict], schema: str, keep: list[str], text: str = "text") -> DataFrame:
    """Add the columns of ``schema`` that ``fn`` derives from each batch of texts.

    ``keep`` names the input columns that pass through; columns of ``df`` beyond these and
    the text are never read, so their names can't clash with the new ones.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    bounded(df.sparkSession)
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    added = _parse_datatype_string(schema)
    out = StructType([*(source.schema[k] for k in keep), *added.fields])
    names = [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        begin_task(fn.__module__)
        target = to_arrow_schema(out)
        for batch in (part for whole in batches for part in sliced(whole, "__text")):
            made = fn(texts_of(batch, "__text"))
            columns = [batch.column(i).cast(target.field(i).type) for i in range(len(keep))]
            for n in names:
                x = made[n]
                columns.append(x if isinstance(x, pa.Array) else pa.array(x, target.field(n).type))
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return source.mapInArrow(run, out)
