"""Shared pieces: table access, lineage cuts in the shared folder, vectorized word and shingle hashes."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of an Arrow batch that the Python operators take at once, in bytes, so that long documents fit a worker.
PIECE_BYTES = 1 << 20
#: What Spark hands to a Python worker at once while a table is written.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
#: A key with more than one in HOT of a join's rows is joined apart; there are fewer than HOT of them.
HOT = 1000
#: Rows that a key must have to be joined apart; fewer are no load for a task.
HOT_ROWS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int | str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts or binaries in a column have about ``size`` bytes; a row is never cut."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and all runs on one machine (tests) a folder of this process takes its place; on a cluster
    it must be set, since no folder of a machine would do.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = f"/tmp/checkpoints/incognita-{os.getpid()}"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and rereads it: later jobs, and retries after lost executors, start there.

    The table goes when the application ends, or with ``drop`` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(BATCH[0])
    spark.conf.set(*BATCH)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH[0], before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` returned; no plan may read them afterwards."""
    for t in tables:
        where, system = _file_system(t.sparkSession, t._written_to)
        system.delete(where, True)


def often(rows: Column, total: int) -> Column:
    """Whether a key with so many rows of all is joined apart."""
    return (rows * HOT > total) & (rows >= HOT_ROWS)


def unskewed(many: DataFrame, one: DataFrame, key: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has one row for each key and in column ``rows`` how many of the ``total`` rows of
    ``many`` have it.

    The rows of keys with more than one in HOT of them would meet in a task. These keys, fewer than HOT as their rows add
    up to ``total`` at most, are broadcast if there are any; the others are dealt by key. Keys that ``one`` lacks must have
    few rows. ``one`` is looked through for such keys at once, so it should be a table.
    """
    is_hot = often(F.col(rows), total)
    hot = one.where(is_hot)
    if total < HOT_ROWS or hot.isEmpty():
        return many.join(one, key, how)
    rest = many.join(F.broadcast(hot.select(*key)), key, "left_anti").join(one.where(~is_hot), key, how)
    return rest.unionByName(many.join(F.broadcast(hot), key, "left_semi" if how == "left_semi" else "inner"))


def partitions_for(spark: SparkSession) -> int:
    """Shuffle partitions as the session sets them; an int to hand to ``repartition``."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- vectorized hashing -------------------------------------------------------------------------------------------

_U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random odd 64-bit value for each byte, so that polynomial hashes don't depend on byte order alone.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                cls.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64))])
                cls.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _INVERSE, np.uint64))])
        return cls.up, cls.down


def word_hashes(texts: list[str | bytes | None], bytes_at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the number of words of each text.

    A-Z count as a-z; words are maximal runs without space, tab, LF, VT, FF and CR. Null counts as empty; bytes are UTF-8.
    The texts are joined with line ends and hashed as a whole, in pieces of about ``bytes_at_once``.
    """
    hashes, counts, piece, size = [], [], [], 0
    for t in texts:
        b = (t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")).lower()
        piece.append(b)
        size += len(b) + 1
        if size >= bytes_at_once:
            h, n = _hash_piece(piece)
            hashes.append(h)
            counts.append(n)
            piece, size = [], 0
    if piece:
        h, n = _hash_piece(piece)
        hashes.append(h)
        counts.append(n)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def _hash_piece(piece: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([b"", *piece, b""]), np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    up, down = _Powers.get(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=run[1:])
    h = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter(map(len, piece), np.int64, len(piece))
    first = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
    return h, np.diff(np.searchsorted(starts, first))


_SEED = [_U(int(x) | 1) for x in _rng.integers(2**62, 2**63, 64, dtype=np.uint64)]


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` words of each text (not yet distinct) and the number for each text.

    A text with 1 to ``width`` - 1 words has one shingle, its whole sequence; a text without words has none.
    """
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offset = np.concatenate([[0], np.cumsum(counts)])[:-1]
    total = int(n.sum())
    at = np.repeat(offset - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(total)
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    span = np.repeat(np.minimum(counts, width), n)
    short = bool((span < width).any())
    for k in range(width):
        term = padded[at + k] * _SEED[k]
        out += np.where(span > k, term, _U(0)) if short else term
    return mix(out + span.astype(np.uint64)), n


def distinct_per_text(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their number."""
    out, sizes, at = [], np.zeros(len(counts), np.int64), 0
    for k, n in enumerate(counts.tolist()):
        v = np.sort(values[at : at + n])
        at += n
        if n > 1:
            v = v[np.concatenate([[True], v[1:] != v[:-1]])]
        out.append(v)
        sizes[k] = len(v)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
