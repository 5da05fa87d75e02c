"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step holds at a time inside a Python worker.
SLICE_BYTES = 4 << 20
#: Bytes of text that an encoder takes at a time: more rows repeat more words.
GATHER_BYTES = 4 << 20


#: Folders of intermediate tables by application, until release() deletes them.
_KEPT: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session without one gets a folder of its own."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marlstone-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marlstone/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """written(), for an intermediate table that release() deletes."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _KEPT.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """How many intermediate tables there are now."""
    return len(_KEPT.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the intermediate tables made since a mark, but those whose name is in keep. No result may still need them."""
    tables = _KEPT.get(spark.sparkContext.applicationId, [])
    for path in tables[since:]:
        if path.rsplit("/", 1)[1] not in keep:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    tables[since:] = [p for p in tables[since:] if p.rsplit("/", 1)[1] in keep]


def tidy(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps now: it notices only when the driver collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying the bytes."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most `size` bytes of text, or one longer row."""
    if batch.num_rows == 0:
        return
    at = batch.schema.get_field_index(column)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, done + size, "right")))
        yield batch.slice(start, end - start)
        start, done = end, int(sizes[end - 1])


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int = GATHER_BYTES) -> Iterator[pa.RecordBatch]:
    """Join small batches, and cut large ones, to parts of about `size` bytes of text, or one longer row."""
    held: list[pa.RecordBatch] = []
    nbytes = 0
    for batch in batches:
        for part in slices(batch, column, size):
            held.append(part)
            nbytes += part.nbytes
            if nbytes >= size:
                yield _joined(held)
                held, nbytes = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i] .. starts[i] + lengths[i] for every i."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
