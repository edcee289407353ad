"""Shared pieces: the cluster's scratch folder, written tables and Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Rows and text bytes handed to Python code at once; bounds a worker's memory.
SLICE_ROWS = 2048
SLICE_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder of
    its own; any other session is refused, because executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="pagegrain-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and reads it again, which cuts its
    lineage: a lost executor costs only its running tasks."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def slices(batch: pa.RecordBatch, weigh: str | int | None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of bounded rows and bytes; a single row may be larger."""
    n = batch.num_rows
    if weigh is None:
        for at in range(0, n, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        return
    lengths = pc.binary_length(batch.column(weigh)).fill_null(0).to_pylist()
    start = held = 0
    for i, size in enumerate(lengths):
        if i > start and (held + size > most or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < n:
        yield batch.slice(start, n - start)


def map_columns(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: Sequence[tuple[str, DataType, pa.DataType]],
    make: Callable[[], Callable[..., Sequence[Sequence]]],
    weigh: str | None = None,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Adds columns made by Python code from Arrow batches, all others kept.

    ``make`` runs once per task and returns the function that turns the input
    columns (Arrow arrays) of a slice into one sequence per output column. An
    input column with the name of an output column is replaced. A slice holds at
    most ``most`` bytes of the column ``weigh``, or a single row. Each column is
    sent to Python once: a batch lies in the executor and in its worker alike.
    """
    names = {n.lower() for n, _, _ in outputs}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    sent = [f.name for f in kept]
    sent += [c for c in dict.fromkeys(inputs) if c not in sent]
    n_kept = len(kept)
    # mapInArrow looks its columns up unquoted, so none keeps a name with dots
    wide = df.select(*[F.col(_q(c)).alias(f"_{i}") for i, c in enumerate(sent)])
    schema = StructType([*kept, *[StructField(n, t) for n, t, _ in outputs]])
    taken = [sent.index(c) for c in inputs]
    weigh_at = sent.index(weigh) if weigh else None
    arrow = [t for _, _, t in outputs]
    titles = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, weigh_at, most):
                made = work(*[part.column(i) for i in taken])
                arrays = [part.column(i) for i in range(n_kept)]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names=titles)

    return wide.mapInArrow(run, schema)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> str:
    """A column name that holds even with dots in it."""
    return _q(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
