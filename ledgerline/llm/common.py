"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

T = TypeVar("T")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_resident: dict[str, object] = {}


def resident(name: str, build: Callable[[], T]) -> T:
    """A table that a Python worker keeps between tasks. Asking for another one drops it, so tables of several operators never add up."""
    if name not in _resident:
        if _resident:
            _resident.clear()
            trim()
        _resident[name] = build()
    return _resident[name]


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system, so that stages do not keep each other's peaks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python some megabytes at a time: batches of ten thousand rows, the default, are held several times over by the
    executor and by its workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def slices(rows: Iterator[pa.RecordBatch], n_bytes: int = 2 << 20, n_rows: int = 1024) -> Iterator[list[list]]:
    """The batches' columns as lists, about ``n_bytes`` of the second column (texts, as bytes) or ``n_rows`` rows at a time."""
    for batch in rows:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            j = min(max(i + 1, int(np.searchsorted(ends, before + n_bytes, side="right"))), i + n_rows)
            yield [c.to_pylist() for c in batch.slice(i, j - i).columns]
            i = j


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: str, how: str, salts: int = 16) -> DataFrame:
    """``big`` joined with ``small`` on ``key``: rows of ``big`` with a hot key are spread by another column over ``salts`` copies of
    ``small``'s row. AQE broadcasts ``small`` where its size, once known, is small enough."""
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(copies, [key, "_salt"], how).drop("_salt")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of the text, null as empty: Arrow hands bytes to Python without decoding."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c, F.lit("")).cast("binary")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
