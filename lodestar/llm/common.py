"""What the operators share: scratch tables, Arrow text as bytes, word and shingle hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that the numpy code works on at once; one longer text is worked on alone.
PIECE = 1 << 18
#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as texts may be long; a smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = spark.conf.get(name).removesuffix("b")  # without a default of ours, so that Spark's own one is seen
    if not digits.isdigit() or int(digits) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in a new folder below spark.checkpoint.dir, which driver and executors share.

    A table written there cuts the lineage and outlives an executor. The folder is not removed here,
    as lazy results read it; the owner of spark.checkpoint.dir clears it. Where that setting is unset, as in tests,
    a local session gets a folder of this machine; on a cluster it is an error, as executors would not see such a folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="lodestar-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.path = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        df.write.options(**options).mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; a null doc_id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def append_columns(df: DataFrame, fn: Callable, fields: Sequence[T.StructField], drop: Sequence[str] = ()) -> DataFrame:
    """df with new columns in place of any of the same names; fn: RecordBatch -> list of arrays, one for each field."""
    bound_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    names, schema = [f.name for f in kept], T.StructType([*kept, *fields])
    labels = [f.name for f in schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *fn(batch)], names=labels)

    return df.mapInArrow(tidy(run), schema)


def tidy(run: Callable) -> Callable:
    """run, with the memory that its arrays leave given back at its end: a Python worker stays for other tasks."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns of these names called otherwise, and a function that drops the new ones and calls those as before."""
    clash = [n for n in names if n in df.columns]
    aside = df.withColumnsRenamed({n: f"{n}__given" for n in clash})
    return aside, lambda out: out.drop(*names).withColumnsRenamed({f"{n}__given": n for n in clash})


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text starts, with the end; null is an empty text."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many bytes each; a longer text comes alone."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last
        first = last


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: letters, digits and whatever is not ASCII; or all that is not white space.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in range(256)])
DARK = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64)


class Powers:
    """Powers of the base of polynomial hashes modulo 2**64, and of its inverse; they grow as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, PIECE + 1)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray, powers: Powers, numbers: np.ndarray = _BYTES) -> np.ndarray:
    """S with S[j] - S[i] = base**i times the polynomial hash of bytes i..j, each byte standing for one of the numbers."""
    up, _ = powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(numbers[data] * up[: len(data)], out=out[1:])
    return out


def word_hashes(data: np.ndarray, at: np.ndarray, is_word: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, lower-cased A-Z, and where each text's words start, with the end."""
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = is_word[data]
    inner = at[1:-1]
    begin, end = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] = mask[1:-1][inner]
    end[inner - 1] = mask[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    s, (_, down) = prefix_hash(LOWER[data], powers), powers.get(len(data) + 1)
    return mixed((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; those that cross from one text to the next are the caller's to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return out
