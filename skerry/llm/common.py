"""What the operators share: reading, cutting lineage, running Arrow batches, hashing words.

Python functions of this package travel to executors by value, so a cluster needs no copy of it.
"""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules["skerry.llm"])

BROADCAST_ROWS = 500_000
"""Keys (16 bytes each) that may be broadcast."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset (as in tests)."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if own is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return own or "file://" + tempfile.mkdtemp(prefix="skerry-checkpoint-")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whichever store it is."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def release() -> None:
    """Give memory that this worker no longer uses back to the system: workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over the columns of df; a worker gives back what it used when it is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def raw_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string or binary column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


GROUP_BYTES = 1 << 22


def row_groups(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows that hold size bytes of a text column, or of one row, so what is made of them stays small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + size, side="right")))
        yield at, end - at
        at = end


def text_groups(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """The UTF-8 bytes of a text column by row_groups."""
    for at, n in row_groups(column, size):
        yield raw_bytes(column.slice(at, n))


def with_last(df: DataFrame, column: str) -> DataFrame:
    """df with a column moved to the end, so that functions on batches find it there and it travels once."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != column), F.col(f"`{column}`"))


def as_before(made: DataFrame, df: DataFrame, *new: str) -> DataFrame:
    """The columns of df in their order, then the new ones."""
    return made.select(*(F.col(f"`{c}`") for c in (*df.columns, *new)))


def names_of(schema: str) -> list[str]:
    """The column names of a flat schema string."""
    return [x.split()[0] for x in schema.split(", ")]


def pick(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are among those wanted (a materialized table), found before anything is shuffled where the keys are few.

    Up to BROADCAST_ROWS keys are broadcast; beyond that rows come back as they are, and the caller's join does the work.
    """
    own = wanted.select(*keys)
    return rows.join(F.broadcast(own), keys, "left_semi") if own.count() <= BROADCAST_ROWS else rows


def row_bucket(column: str, buckets: int) -> F.Column:
    """crc32 of the id as text, modulo buckets; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % buckets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer: spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SLICE, LONG_WORD = 1 << 15, 256
SPACES = b" \t\n\v\f\r"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.isin(np.arange(256), list(SPACES))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER, _INVERSE = _powers(_BASE, SLICE), _powers(pow(_BASE, -1, 2**64), SLICE)


def _hash_slice(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    space = np.ones(len(data) + 2, dtype=bool)
    np.take(_IS_SPACE, data, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _POWER[: len(data)], out=sums[1:])
    out = mix64((sums[ends] - sums[starts]) * _INVERSE[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]])
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text (split at ASCII white space), each the same wherever its word stands.

    A word is a polynomial over its bytes, found from prefix sums of the text, so there is no loop over words; words of
    more than LONG_WORD bytes, where such polynomials could be made to collide, are hashed one by one. Long texts are
    taken in slices that end at white space, so memory beyond the result is bounded by SLICE and the longest word.
    """
    if len(text) <= SLICE:
        return _hash_slice(text)
    parts, at = [], 0
    while at < len(text):
        found = _SPACE.search(text, at + SLICE // 2)
        end = found.end() if found else len(text)
        if end - at <= SLICE:
            parts.append(_hash_slice(text[at:end]))
        else:  # a long word is in it
            words = text[at:end].split()
            parts.append(np.array([xxhash.xxh64_intdigest(w) if len(w) > LONG_WORD else int(_hash_slice(w)[0]) for w in words], dtype=np.uint64))
        at = end
    return np.concatenate(parts)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of width consecutive word hashes, by binary composition."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    done, out, power, size, left = 0, None, words, 1, width
    while left:
        if left & 1:
            part = power[done : done + n]
            out = mix64(part + np.uint64(0x9E3779B97F4A7C15)) if out is None else mix64(out * np.uint64(0xD6E8FEB86659FD93) + part)
            done += size
        left >>= 1
        if left:
            power = mix64(power[:-size] * np.uint64(0xA0761D6478BD642F) + power[size:])
            size *= 2
    return out


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sliding_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of width keys, in linear time: prefix and suffix minima of blocks of that width."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(keys.dtype).max, dtype=keys.dtype)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def int_lists(parts: list[np.ndarray], kind: pa.DataType, dtype: type) -> pa.ListArray:
    """A list column from arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts).astype(dtype, copy=False) if parts else np.empty(0, dtype=dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def list_parts(column: pa.ListArray, dtype: type) -> list[np.ndarray]:
    """The arrays of a list column without nulls inside; a null list is empty."""
    values = np.asarray(column.values).astype(dtype, copy=False)
    offsets = np.asarray(column.offsets)
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist(), strict=False)]


def order_id(column: str) -> F.Column:
    """An id for comparisons: a null id is larger than all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(2**63 - 1))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
