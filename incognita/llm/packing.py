"""Bounded-space online packing of tokenized documents into sequences of at most 2048 tokens.

Each task streams its documents past a fixed number of open windows. The part of a document that fills whole sequences
is emitted at once; the rest goes to the window that it fits best. When it fits none, the fullest window is topped up
with a cut of it and emitted, so that emitted sequences are full. At the end of a task the windows are merged into full
sequences and one leftover; leftovers, under one sequence a task, are merged in groups of tasks, level by level.

Documents may be cut anywhere; each token lies in exactly one piece. Only the last sequence of all is not full; where
its length is no power of two, it counts as padded to 2048.

Ids are those of the tokenizer as its file has it: its special tokens' strings in a text are these tokens.

Edge cases: null and empty texts are the end token alone; repeated rows are packed each, every piece with its row's
doc_id (also null); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 2048
OPEN = 64
END = 1
#: Leftovers that meet in one task at each level of the final merge.
FAN_IN = 64
#: Words kept with their ids in a Python worker, and the bytes of the longest that is.
CACHED = 700_000
LONGEST_KEPT = 64
#: Text split into words at a time, in bytes; it is cut at white space only.
AT_ONCE = 1 << 20
#: Room for the sequences of one task in a sequence_id.
SPAN = 1 << 32

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_STOP = re.compile(rb"[.,](?<=[a-z][.,])(?=\s|\Z)")  # begins with its sign, which is quick to look for
PIECE = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long"


class Encoder:
    """Texts to token ids (little-endian 32-bit), word by word: the vocabulary's pieces never cross white space.

    A full stop or comma between an ASCII letter and white space is a piece of its own, and A-Z are read as a-z, so both
    are parted and folded before words are looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are found in whole texts, before case is folded
        self.known: dict[bytes, bytes] = {}
        added = {t.content.encode(): i.to_bytes(4, "little") for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added, self.special = added, re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")") if added else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; words of about AT_ONCE bytes are tokenized together."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0
        for k, t in enumerate(texts):
            for piece in self._pieces((t or "").encode("utf-8", "surrogatepass")):
                if piece in self.added:
                    waiting.append((k, piece))
                else:
                    waiting.append((k, _STOP.sub(rb" \g<0>", piece.lower()).split()))
                    size += len(piece)
                if size >= AT_ONCE:
                    self._put(waiting, out)
                    waiting, size = [], 0
        self._put(waiting, out)
        return [b"".join(ids) for ids in out]

    def _pieces(self, text: bytes) -> Iterator[bytes]:
        """The text between the added tokens' strings, in pieces that end before white space, and those strings."""
        for part in self.special.split(text) if self.special and b"<|" in text else (text,):
            if part in self.added:
                yield part
                continue
            start = 0
            while start < len(part):
                m = _SPACE.search(part, start + AT_ONCE) if len(part) - start > AT_ONCE else None
                end = m.start() if m else len(part)
                yield part[start:end] + b" " * bool(m)
                start = end

    def _put(self, waiting: list[tuple[int, bytes | list[bytes]]], out: list[list[bytes]]) -> None:
        new: set[bytes] = set()
        for _, words in waiting:
            if isinstance(words, list):
                new.update(filterfalse(self.known.__contains__, words))
        rare = self._ids(list(new))
        known = self.known.__getitem__
        for k, words in waiting:
            if not isinstance(words, list):
                out[k].append(self.added[words])
            elif not rare:
                out[k].append(b"".join(map(known, words)))
            else:
                out[k].append(b"".join([rare[w] if w in rare else known(w) for w in words]))

    def _ids(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Learns the ids of words; those that aren't kept, since they are long or there is no room, are returned."""
        if not new:
            return {}
        encoded = self.tokenizer.encode([w.decode("utf-8", "replace") for w in new], is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(encoded.word_ids, np.int64), np.arange(len(new)), "right")
        data, at, rare = np.array(encoded.ids, "<u4").tobytes(), 0, {}
        if len(self.known) + len(new) > CACHED:
            kept = dict(islice(self.known.items(), CACHED // 3))  # the first to come are the frequent ones
            rare = {w: ids for w, ids in self.known.items() if w not in kept}
            self.known = kept
        for w, end in zip(new, (ends * 4).tolist()):
            if len(w) <= LONGEST_KEPT:
                self.known[w] = data[at:end]
            else:
                rare[w] = data[at:end]
            at = end
        return rare


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """This process's encoder: what it knows serves all tasks that run here."""
    return Encoder(path)


class Packer:
    """Windows of one task; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN):
        self.length, self.windows, self.open, self.filled = length, windows, [], []

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        """Places the tokens, cutting where a window ends."""
        full, at, n = self.length * 4, 0, len(ids)
        while n - at >= full:
            self.filled.append([(doc, start + at // 4, ids[at : at + full], total)])
            at += full
        rest, start = ids[at:], start + at // 4
        while rest:
            room = [full - used for used, _ in self.open]
            fits = [(r, i) for i, r in enumerate(room) if r >= len(rest)]
            if fits:
                self._put(min(fits)[1], (doc, start, rest, total))
                return
            if len(self.open) < self.windows:
                self.open.append((0, []))
                continue
            i = min(range(len(room)), key=room.__getitem__)
            head = room[i]
            self._put(i, (doc, start, rest[:head], total))
            rest, start = rest[head:], start + head // 4

    def _put(self, i: int, piece: tuple) -> None:
        used, pieces = self.open[i]
        used += len(piece[2])
        pieces.append(piece)
        if used == self.length * 4:
            self.filled.append(pieces)
            self.open.pop(i)
        else:
            self.open[i] = (used, pieces)

    def take(self) -> list[list[tuple]]:
        """The sequences filled since the last call."""
        out, self.filled = self.filled, []
        return out

    def close(self) -> list[tuple]:
        """Merges the open windows, fullest first, into full sequences (see ``take``); returns the leftover pieces."""
        rest = Packer(self.length, 1)
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for p in pieces:
                rest.add(*p)
        self.filled += rest.filled
        self.open = []
        return rest.open[0][1] if rest.open else []


def _batch(sequences: list[list[tuple]], first: int, task: int, keep: bool) -> pa.RecordBatch:
    """keep: leave the ids in the rows, for pieces that may be cut again."""
    rows, seq, offsets = [], [], []
    for k, pieces in enumerate(sequences):
        at = 0
        for p in pieces:
            rows.append(p)
            seq.append(-1 if keep else first + k)
            offsets.append(at)
            at += len(p[2]) // 4
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([len(r[2]) // 4 for r in rows], pa.int64()),
            pa.array([r[2] if keep else None for r in rows], pa.binary()),
            pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.int64()),
            pa.array(seq, pa.int64()),
            pa.array(offsets, pa.int64()),
            pa.array([task] * n, pa.int64()),
        ],
        [c.split()[0] for c in PIECE.split(", ")],
    )


def _stream(pieces: Iterator[tuple], task: int, first: int, length: int, windows: int, last: bool) -> Iterator[pa.RecordBatch]:
    packer, number, ready = Packer(length, windows), first, []
    for p in pieces:
        packer.add(*p)
        if packer.filled:
            ready += packer.take()
            if len(ready) >= 256:
                yield _batch(ready, number, task, False)
                number += len(ready)
                ready = []
    rest = packer.close()
    ready += packer.take()
    if last and rest:
        ready, rest = [*ready, rest], []
    if ready:
        yield _batch(ready, number, task, False)
    if rest:
        yield _batch([rest], 0, task, True)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, windows: int = OPEN) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def pieces() -> Iterator[tuple]:
            for whole in batches:
                for b in common.slices(whole, 1):
                    for doc, ids in zip(b.column(0).to_pylist(), encoder(tokenizer).encode(b.column(1).to_pylist())):
                        ids += END.to_bytes(4, "little")
                        yield doc, 0, ids, len(ids) // 4

        yield from _stream(pieces(), task, task * SPAN, length, windows, False)

    def level(base: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()

            def pieces() -> Iterator[tuple]:
                for b in batches:
                    yield from zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")))

            yield from _stream(pieces(), task, base + task * SPAN, length, 1, last)

        return run

    now = common.cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first_level, PIECE), "packed")
    done, base = [], SPAN * SPAN // 4
    tasks = (now.agg(F.max("task").alias("t")).first()["t"] or 0) + 1
    while True:
        done.append(now.where("ids is null"))
        groups = -(-tasks // FAN_IN)
        left = now.where("ids is not null")
        dealt = left.repartition(groups, F.floor(F.col("task") / FAN_IN)) if groups > 1 else left.coalesce(1)
        if groups == 1:
            done.append(dealt.sortWithinPartitions("task", "offset").mapInArrow(level(base, True), PIECE))
            break
        now = common.cut(dealt.sortWithinPartitions("task", "offset").mapInArrow(level(base, False), PIECE), "packed")
        base += SPAN * groups
        tasks = groups
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.drop("ids", "task")
