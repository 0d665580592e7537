"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows, each a sequence of its own, and a rest, and a rest into pieces of
at most PIECE ids, so that a window has several and sums can meet. They are dealt out BATCH at a time: each starts as a partial partition over k windows, k the least that could hold them;
the two partitions with the largest imbalance are merged, the fullest window of one with the emptiest of the
other, until one is left. Its windows are near-equal; k rises whenever one exceeds the capacity.

Everything happens where a document is read: no shuffle, no gathered group, memory by batch. A sequence id holds
the number of the partition that its documents are read in, as the plan has it beneath the packing, so a task that
runs again gives the same ids, and whatever later merges, moves or unites partitions leaves them apart. Ids are
unique within one call; results that are to be united get a different `run_number` each.

Defined results: a null or empty text has only its end id; a text of a whole number of windows has no rest;
repeated rows are packed each on its own; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tokens import encoder, little_batches

CAPACITY = 1024

#: Ids of the largest piece of a rest.
PIECE = 256

#: Pieces of rests that are dealt out together, about.
BATCH = 1024

#: Where a sequence id has the run and the partition; its lowest bits count.
RUN_AT, PART_AT = 48, 24

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each size: largest differencing over k-tuples, merged with opposing order."""
    n = len(sizes)
    if k <= 1:
        return np.zeros(n, np.int64)
    # A node's tuple is sorted downwards and less its least; made[i] says which slots of which two nodes each of its slots joins.
    tuples: dict[int, np.ndarray] = {}
    heap = []
    for i, x in enumerate(sizes.tolist()):
        t = np.zeros(k, np.int64)
        t[0] = x
        tuples[i] = t
        heap.append((-x, i))
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    up = np.arange(k - 1, -1, -1)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = tuples.pop(a) + tuples.pop(b)[up]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        node = n + len(made)
        made.append((a, b, order))
        tuples[node] = both
        heapq.heappush(heap, (-int(both[0]), node))
    window = np.zeros(n, np.int64)
    slots = {heap[0][1]: np.arange(k)}  # of a node: the window of each of its slots
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b, order = made[node - n]
        own = np.empty(k, np.int64)
        own[order] = slots.pop(node)
        for child, s in ((a, own), (b, own[up])):
            if child < n:
                window[child] = s[0]
            else:
                slots[child] = s
    return window


def pack_rests(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size, none over capacity; sizes are at most capacity."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        most = int(np.bincount(window, weights=sizes, minlength=k).max())
        if most <= capacity:
            return window
        k += max(1, k * (most - capacity) // (4 * capacity))


class Packer:
    """Gathers documents and gives their pieces; sequence ids count up from first_sequence."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, batch: int = BATCH, piece: int = PIECE):
        self.next, self.capacity, self.batch, self.piece = first_sequence, capacity, batch, piece
        self.rests: list[tuple] = []

    def add(self, doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> list[list[tuple]]:
        out = []
        for doc, a, z in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = ids[a:z].astype("<u4")
            n, full = z - a, (z - a) // self.capacity * self.capacity
            if full:
                out.append([(doc, s, self.capacity, zlib.crc32(own[s : s + self.capacity]), n, self.next + s // self.capacity, 0) for s in range(0, full, self.capacity)])
                self.next += full // self.capacity
            if n > full:
                for s in range(full, n, self.piece):
                    part = own[s : s + self.piece]
                    self.rests.append((doc, s, len(part), zlib.crc32(part), n))
                if len(self.rests) >= self.batch:
                    out.append(self.flush())
        return out

    def flush(self) -> list[tuple]:
        sizes = np.array([r[2] for r in self.rests], np.int64)
        window = pack_rests(sizes, self.capacity)
        order = np.argsort(window, kind="stable")
        out, used, last = [], 0, -1
        seen = -1
        for i in order.tolist():
            if window[i] != last:
                last, used, seen = window[i], 0, seen + 1
            out.append((*self.rests[i], self.next + seen, used))
            used += int(sizes[i])
        self.next += seen + 1
        self.rests = []
        return out


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = CAPACITY, batch: int = BATCH, piece: int = PIECE, run_number: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*pieces, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer = encoder(tokenizer_file, False), None
        for b in batches:
            if b.num_rows and packer is None:
                packer = Packer(run_number << RUN_AT | b.column(2)[0].as_py() << PART_AT, capacity, batch, piece)
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in little_batches(texts):
                ids, bounds = code.encode(texts[a:z])
                n = z - a
                ends = bounds[1:] + np.arange(1, n + 1)
                all_ids = np.insert(ids, bounds[1:], end_id)
                pieces = packer.add(doc_ids[a:z], all_ids, np.concatenate([[0], ends]))
                if pieces:
                    yield rows([p for part in pieces for p in part])
        if packer and packer.rests:
            yield rows(packer.flush())

    return docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part")).mapInArrow(run, PIECES)
