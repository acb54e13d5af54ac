"""What the operators share: tables, the shared folder, ASCII rules for words."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, where that is unset below the warehouse, which all executors see too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/quillstage-{uuid.uuid4().hex}"


#: Tables that ``written`` has made within each open ``scratch``.
_SCRATCH: list[list[DataFrame]] = []


def written(df: DataFrame, name: str = "table", keep: bool = False, codec: str | None = None, group: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: short lineage that outlives executors. With ``keep`` no ``scratch`` deletes it.

    A task holds a row group whole, unpacked, in writing and in reading, and without ``group``, the most rows of one, it has a hundred
    at least: too many where a row is megabytes.
    """
    path = f"{shared_dir(df.sparkSession)}-{name}"
    (df.write.option("parquet.block.row.count.limit", group) if group else df.write).parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` on which nothing lazy depends any more."""
    for table in tables:
        drop_table(table.sparkSession, table.written_to)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end whatever ``written`` has made within it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        discard(*_SCRATCH.pop())


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever that is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, rows go to Python workers in batches of at most ``most`` bytes or a single row: for rows that are large themselves."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def local_path(uri: str) -> str:
    """The path of a file: URI, as Python opens it."""
    return uri[len("file:"):].replace("///", "/", 1) if uri.startswith("file:") else os.fspath(uri)


def make_room(user: str) -> None:
    """Called in a task: modules of this package but ``user`` forget what they hold between tasks, for Python workers serve one operator after another."""
    held = [m for name, m in sys.modules.items() if name.startswith("quillstage.llm.") and name != user and hasattr(m, "forget")]
    if any([m.forget() for m in held]):
        try:
            import ctypes

            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library keeps what it has


def words_of(text: Column) -> Column:
    """The words of a text as an array, in Spark's own functions; none where it is null or blank."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def gram_hashes(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Adds ``out``: a 64-bit hash of every 5 elements in a row of the array ``hashes``, rolled up by pairs and fours."""
    n = F.size(hashes)

    def rolled(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    def part(name: str, start: int, length: Column) -> Column:
        return F.slice(name, start, F.greatest(length, F.lit(0)))

    df = df.withColumn("__two", rolled(part(hashes, 1, n - 1), part(hashes, 2, n - 1)))
    df = df.withColumn("__four", rolled(part("__two", 1, n - 3), part("__two", 3, n - 3)))
    return df.withColumn(out, rolled(part("__four", 1, n - 4), part(hashes, 5, n - 4))).drop("__two", "__four")


def raw_bytes(texts) -> tuple:
    """The UTF-8 bytes of an Arrow array of texts one behind the other, and where each text begins there, with the end; null texts are empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def word_spans(inside, begins) -> tuple:
    """First byte and end of every word: runs of bytes that are ``inside`` and of one text; the texts begin at ``begins``."""
    import numpy as np

    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = begins[:-1][begins[:-1] < begins[1:]]
    first[some] = inside[some]
    ends = begins[1:][begins[:-1] < begins[1:]] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def slices_by_size(texts, most: int, rows: int = 1 << 16):
    """Runs of an Arrow array of at most ``rows`` texts, of at most ``most`` bytes together or a single one, with the number of the first."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield first, texts.slice(first, last - first)
        first = last
