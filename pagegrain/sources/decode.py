"""Pages out of binary files, where a decoder is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "path string, page int, word_seq long, text string, x0 double, x1 double, top double, bottom double, fontname string, size double, upright boolean, page_width double, page_height double, problem string"
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def decoded(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[dict]], pattern: str = "*.pdf") -> DataFrame:
    """Words of every file under ``path``. ``decode`` yields a file's words in
    flow order as dicts of the columns of ``words``; a file that it can't read
    gives one row that says why. No decoder is built in."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in WORDS.split(", "))])
        for batch in batches:
            for file in batch.to_pylist():
                try:
                    rows = [{"path": file["path"], "word_seq": i, **w} for i, w in enumerate(decode(file["content"]))]
                except Exception as error:  # whatever a decoder raises belongs to the file
                    rows = [{"path": file["path"], "problem": f"{type(error).__name__}: {error}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, shape)

    return files.mapInArrow(run, WORDS)


def problems(words: DataFrame) -> DataFrame:
    return words.where(F.col("problem").isNotNull()).select("path", "problem")
