"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every distinct hash of a document's five-word shingles that lies below a fixed fraction of the hash range; a
document of at most ``FEW`` shingles keeps them all, so that short documents can be told apart and compared. Two sketches
are compared where both are whole: below the fraction, or everywhere if both have hashes beyond it. ``merge`` gives the
sketch of the union of two documents' shingles (those that span the seam of joined texts belong to neither). The share of
one sketch found in another estimates containment between documents of very unequal length.

A fingerprint is a sketch as text: eight bytes a hash in base64, so about 2.7 characters a word beyond ``FEW`` words; it
grows with the document, as a mergeable sketch must.

Edge cases: null text counts as empty; a text without words has the fingerprint ``""``, alike (1.0) to the same and
unlike (0.0) to others; equal texts have equal fingerprints; rows that share a doc_id are ordered by a hash of their text,
null ids come first; a table of one row is its own next document; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5
#: A hash is kept if it is below 2^64 / SCALE.
SCALE = 4
LIMIT = np.uint64(2**64 // SCALE)
#: Shingles up to which a document keeps all.
FEW = 64
#: Documents in one stretch of the order, and the most stretches; a task streams its stretch, so a larger one takes longer
#: but no more memory.
STRETCH = 2000
MOST = 1 << 14
#: Rows drawn for each stretch to place its border.
DRAWN = 16


def sketch(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted sketch of each text."""
    values, sizes = common.distinct_per_text(*common.shingle_hashes(*common.word_hashes(texts), WIDTH))
    out, at = [], 0
    for n in sizes.tolist():
        out.append(_kept(values[at : at + n]))
        at += n
    return out


def _kept(v: np.ndarray) -> np.ndarray:
    """What a sketch keeps of sorted hashes; one that would be empty (a chance of 1e-8) has the smallest."""
    below = v if len(v) <= FEW else v[: int(np.searchsorted(v, LIMIT))]
    return below if len(below) else v[:1]


def write(s: np.ndarray) -> str:
    """A sketch as text: eight bytes for each hash, ascending, in base64."""
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    """The sketch that ``write`` wrote."""
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def _comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of two sketches in which both are whole; a sketch with hashes beyond the limit has them all."""
    if len(a) and len(b) and a[-1] >= LIMIT and b[-1] >= LIMIT:
        return a, b
    return a[: int(np.searchsorted(a, LIMIT))], b[: int(np.searchsorted(b, LIMIT))]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two documents' shingles."""
    if not len(a) or not len(b):
        return a if len(a) else b
    return _kept(np.union1d(*_comparable(a, b)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller document's shingles that the other holds."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = _comparable(a, b)
    if not len(a) or not len(b):
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    return float(np.count_nonzero(long[at] == short)) / len(short)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([write(s) for s in sketch(b.column(1).to_pylist())], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (in code points, rounded down) replaced by as many of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _rows(part: list[tuple[int | None, str]], following: tuple[int | None, str]) -> pa.RecordBatch:
    texts = [t for _, t in part]
    changed = [edited(t, n) for t, n in zip(texts, [*texts[1:], following[1]])]
    own, other = sketch([*texts, following[1]]), sketch(changed)
    columns = {
        "doc_id": pa.array([i for i, _ in part], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array([write(s) for s in own[:-1]], pa.string()),
        "edited_fingerprint": pa.array([write(s) for s in other], pa.string()),
        "near_edited": pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
        "near_next": pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
    }
    return pa.RecordBatch.from_pydict(columns)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KEY = ("given", "id", "hash")


def _stretch(marks: list[tuple[int, int, int]]) -> Column:
    """Number of marks (sorted keys) up to a row's key: a binary search in one constant."""
    if not marks:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([dict(zip(KEY, m)) for m in marks])), "array<struct<given:int,id:bigint,hash:bigint>>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(marks).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= F.struct(*KEY), at + step).otherwise(at))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and the likeness to that and to the next document.

    The order by doc_id, then by a hash of the text, is cut into stretches at quantiles of a drawn sample of keys; each
    stretch also gets the first document of the next one (one more row a stretch), so that no task sees more than its
    stretch and texts move once. What the driver sees are keys: DRAWN and one more a stretch, of MOST stretches at most.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.col("doc_id").isNotNull().cast("int").alias("given"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"), "text")
    n = docs.count()
    parts = min(MOST, max(1, -(-n // STRETCH)))
    drawn = F.pmod(F.xxhash64(F.lit(17), *KEY), F.lit(1 << 40)) < int(min(1.0, DRAWN * parts / max(n, 1)) * (1 << 40))
    sample = sorted(map(tuple, rows.where(drawn).select(*KEY).collect())) if parts > 1 else []
    marks = sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []
    placed = rows.withColumn("stretch", _stretch(marks))
    heads = sorted((r.stretch, tuple(r.head)) for r in placed.groupBy("stretch").agg(F.min(F.struct(*KEY)).alias("head")).collect())
    guests = [(*head, s) for (s, _), (_, head) in zip(heads, [*heads[1:], *heads[:1]])]
    named = spark.createDataFrame(guests, "given int, id long, hash long, guest int")
    heading = rows.join(F.broadcast(named), list(KEY))
    visiting = heading.groupBy(F.col("guest").alias("stretch"), *KEY).agg(F.min("text").alias("text")).select(*KEY, "text", "stretch", F.lit(1).alias("visit"))
    dealt = placed.select(*KEY, "text", "stretch", F.lit(0).alias("visit")).union(visiting)
    dealt = dealt.repartition(max(parts, common.partitions_for(spark)), "stretch").sortWithinPartitions("stretch", "visit", *KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, at = [], 0, None
        for whole in batches:
            for b in common.slices(whole, 2):
                for given, i, t, s, visit in zip(*(c.to_pylist() for c in b.columns)):
                    row = (i if given else None, t)
                    if s != at and part:
                        raise ValueError("a stretch ended without the head of the next one")
                    at = s
                    if visit:
                        yield _rows(part, row)
                        part, size, at = [], 0, None
                        continue
                    if size > 1 << 21:
                        yield _rows(part, row)
                        part, size = [], 0
                    part.append(row)
                    size += len(t)

    return dealt.select("given", "id", "text", "stretch", "visit").mapInArrow(run, SCHEMA)
