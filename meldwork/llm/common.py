"""What several corpus operators share: scratch tables, Arrow batches, word and shingle hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters that count as white space in lines and words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); only in local mode, where none is set, a folder of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_meldwork_scratch", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark._meldwork_scratch = "file://" + tempfile.mkdtemp(prefix="meldwork-")
    return folder.rstrip("/")


#: What this process has written to the shared folder: paths, and tables of the session's catalog.
_WRITTEN: list[tuple[str, str | None]] = []


def scratch(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A new path in the shared folder; purge() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((path, table))
    return path


def purge(spark: SparkSession) -> None:
    """Delete every intermediate table of this process. Call it when the results that rest on them are written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path, table in _WRITTEN:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    _WRITTEN.clear()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(columns: list[str]) -> list[Column]:
    """The columns of these very names, dots and all."""
    return [F.col(f"`{c}`") for c in columns]


def aside(df: DataFrame, *more: Column) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns under names that no helper has, and those names by the old ones; `more` are columns of df to add."""
    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], *more), inner


def restored(df: DataFrame, inner: dict[str, str], *more: str) -> DataFrame:
    """The columns that aside() has renamed under their old names, and then `more`, which replace old ones of their names."""
    return df.select(*[F.col(n).alias(c) for c, n in inner.items() if c not in more], *more)


#: Rows that Spark sends to Python at once. Its default of 10,000 is made for narrow rows; of whole texts it
#: fills both sides' memory outside the heap.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Set spark.sql.execution.arrow.maxRecordsPerBatch to BATCH_ROWS where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, step: int = 1 << 21) -> DataFrame:
    """mapInArrow over slices of about `step` bytes, so that one batch of long texts doesn't fill a worker.

    """
    small_batches(df.sparkSession)

    names = df.columns
    if any("." in c for c in names):  # mapInArrow can't take such names
        df = df.toDF(*[f"_c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=names)
            rows = max(1, batch.num_rows * step // max(step, batch.nbytes))
            for i in range(0, batch.num_rows, rows):
                yield fn(batch.slice(i, rows))

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> pa.Array:
    """As 64-bit strings, null as empty."""
    return column.cast(pa.large_string()).fill_null("")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes laid end to end, and the rows' offsets in them (one more than rows)."""
    a = pa.concat_arrays([strings(column)])
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _tables(breaks: str) -> tuple[np.ndarray, np.ndarray]:
    is_space = np.zeros(256, bool)
    is_space[[ord(c) for c in breaks]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return is_space, lower


#: Bytes up to which byte_hashes() goes in steps of eight, all pieces at once.
SHORT = 64


def byte_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces of body: eight bytes after eight go through mix(); longer pieces by xxh3.

    No polynomial of the bytes: modulo a power of two there are texts whose polynomials agree in every base.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(_STEP))
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((body, np.zeros(8, np.uint8))), 8)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    alive = np.flatnonzero(size <= SHORT)
    for done in range(0, SHORT, 8):
        alive = alive[size[alive] > done]
        if not len(alive):
            break
        chunk = np.ascontiguousarray(eight[starts[alive] + done]).view("<u8").ravel()
        out[alive] = mix(out[alive] ^ (chunk & masks[np.minimum(size[alive] - done, 8)]))
    for i in np.flatnonzero(size > SHORT):
        out[i] = xxhash.xxh3_64_intdigest(body[starts[i] : ends[i]].tobytes())
    return out


def words(column: pa.Array, breaks: str = SPACES, head: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row, split at `breaks` (ASCII): 64-bit hashes (A-Z lower-cased), row numbers, byte starts and ends.

    A hash is that of the word's bytes (its first `head` bytes, if given).
    """
    body, at = text_bytes(column)
    is_space, lower = _tables(breaks)
    n = len(body)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    inside = ~is_space[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = at[:-1][at[:-1] < n]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = at[1:][at[1:] > 0] - 1
    last[cut] = inside[cut]
    ends = np.flatnonzero(last) + 1
    hashes = byte_hashes(lower[body], starts, ends if head is None else np.minimum(ends, starts + head))
    rows = np.searchsorted(at, starts, "right") - 1
    return hashes, rows, starts - at[rows], ends - at[rows]


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `width` words in each row, sorted by row and hash: (row numbers, hashes).

    A row with fewer words, but at least one, has them all as its one shingle.
    """
    count = np.bincount(rows, minlength=n_rows)
    m = len(hashes) - width + 1
    out_rows, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if m > 0:
        whole = rows[:m] == rows[width - 1 :]
        total = np.zeros(m, np.uint64)
        for j in range(width):
            total = total * np.uint64(_STEP) + hashes[j : m + j]
        out_rows, out = rows[:m][whole], mix(total[whole])
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        begin = np.concatenate(([0], np.cumsum(count)))[:-1]
        short = np.zeros(len(few), np.uint64)
        for j in range(width - 1):
            has = count[few] > j
            short[has] = short[has] * np.uint64(_STEP) + hashes[begin[few[has]] + j]
        short = mix(short + np.uint64(width))
        out_rows, out = np.concatenate((out_rows, few)), np.concatenate((out, short))
    if len(few):
        order = np.argsort(out_rows, kind="stable")
        out_rows, out = out_rows[order], out[order]
    at = np.searchsorted(out_rows, np.arange(n_rows + 1))
    for i, j in zip(at[:-1], at[1:], strict=True):
        out[i:j].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (out_rows[1:] != out_rows[:-1])
    return out_rows[keep], out[keep]
