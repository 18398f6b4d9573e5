"""Helpers shared by the operators: input columns, written stages, Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlens.session import scratch_path

#: ASCII white space of the word rules (space, tab to carriage return).
ASCII_SPACE = " \t\n\u000b\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table (column pruning reaches the scan)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/defectlens/" in f:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(conf).delete(p, True)


def wide_parallelism(spark: SparkSession) -> int:
    """Number of partitions asked of a keyed ``repartition``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def small_batches(spark: SparkSession, rows: int = 1500) -> None:
    """Bound the Arrow batches sent to Python (long texts: by rows and by bytes)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column (null: empty text)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def keyed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a sorted partition, one table each.

    The rows of one run are held in memory, never more; the caller bounds them.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_defectlens_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="defectlens-")) / "defectlens.zip"  # read by the driver's file server only
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._defectlens_shipped = True


def in_arrow(df: DataFrame, fn: Callable, schema: str, rows: int = 1500) -> DataFrame:
    """``mapInArrow`` with bounded batches and this package on the workers."""
    small_batches(df.sparkSession, rows)
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


# Rolling fingerprints: prefix sums of byte * B^i modulo 2^64, B odd, so that
# any substring's value is (P[e] - P[s]) * B^-s, all in numpy.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """B^i and B^-i for i < n, kept for the worker's next batches."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        out = []
        for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over uint64 (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums for :func:`span_hash` over bytes or 64-bit symbols."""
    power = _powers(len(values) + 1)[0]
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the spans [start, end); equal spans, equal values."""
    inverse = _powers(len(prefix))[1]
    return mix64((prefix[end] - prefix[start]) * inverse[start])


def doc_slices(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, one at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def byte_words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each document.

    ``word_byte`` says for each byte value whether it belongs to words; a word
    never crosses a document's end.
    """
    flags = np.zeros(len(data) + len(offsets), bool)  # one gap after each document
    shift = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    flags[np.arange(len(data)) + shift] = word_byte[data]
    start, end = runs_of(flags)
    gaps = offsets[1:] + np.arange(len(offsets) - 1)
    doc = np.searchsorted(gaps, start)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return start - doc, end - doc, first
