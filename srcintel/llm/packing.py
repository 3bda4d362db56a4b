"""Order-preserving packing by dynamic programming over cuts at document and sentence boundaries.

A stream of documents (ids and an end id each) is cut into windows of at most `window` ids. Cuts may fall
after a document (free), after a sentence (`sentence_cost`; bpe.STOPS has the marks of many scripts that end one) or, in runs without either, every `run` ids
(`run_cost`). With G(j) the least cost of cutting the first p_j ids into whole windows,

    G(j) = cost_j + min over i, p_j - p_i <= window, of  G(i) + window - (p_j - p_i)

the term that depends on i is G(i) + p_i, whose minimum over the sliding range of i a monotone queue gives:
linear time in the number of cuts. Blocks of about `block` ids bound the memory; the last window of a block,
which may be short, is opened again in the next, so that only a partition's last window is padded for lack
of documents.

Nulls and empty texts: the end id alone. Repeated rows are packed each for itself. A null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcintel.llm.bpe import ChunkEncoder, tokenizer_path
from srcintel.llm.shared import ship
from srcintel.llm.text import enter, steps

WINDOW = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"


def cut_points(n: int, ends: np.ndarray, sentences: np.ndarray, sentence_cost: int, run: int, run_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may fall, ascending from 0 to n, with their costs. ends: of documents; sentences: of sentences."""
    cost = np.full(n + 1, -1, np.int32)
    cost[sentences] = sentence_cost
    cost[ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    gap = np.diff(at)
    for k in np.flatnonzero(gap > run):  # long runs without a boundary
        cost[at[k] + run : at[k + 1] : run] = run_cost
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int) -> list[int]:
    """Indices into `at` of the ends of the windows, by the recurrence above. Neighbouring cuts are at most `window` apart."""
    pos, costs = at.tolist(), cost.tolist()
    n = len(pos)
    came = [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (G(i) + p_i, i), ascending
    for j in range(1, n):
        p = pos[j]
        low = p - window
        while pos[queue[0][1]] < low:
            queue.popleft()
        value, came[j] = queue[0]
        key = costs[j] + window + value  # G(j) + p_j
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends = []
    j = n - 1
    while j > 0:
        ends.append(j)
        j = came[j]
    return ends[::-1]


def padded_length(n: int, window: int = WINDOW) -> int:
    """The length that a sequence of n ids takes: the window, or n itself if n is a power of two."""
    return n if n & (n - 1) == 0 else window


class _Packer:
    """Packs a partition's documents as they come."""

    def __init__(self, partition: int, window: int, sentence_cost: int, run: int, run_cost: int):
        self.sequence = partition << 40
        self.window, self.costs = window, (sentence_cost, run, run_cost)
        self.ids = np.zeros(0, np.uint32)
        self.owner: list[tuple] = []  # (doc_id, ids of it before, its length) of each document in self.ids
        self.ends = np.zeros(0, np.int64)
        self.sentences = np.zeros(0, np.int64)
        self.out: list[tuple] = []

    def add(self, doc_ids: list, ids: np.ndarray, ptr: np.ndarray, sentences: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, ptr[1:] + len(self.ids)])
        self.sentences = np.concatenate([self.sentences, sentences + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.owner += [(d, 0, n) for d, n in zip(doc_ids, np.diff(ptr).tolist())]

    def pack(self, last: bool) -> None:
        if not len(self.ids):
            return
        at, cost = cut_points(len(self.ids), self.ends, self.sentences, *self.costs)
        ends = at[best_cuts(at, cost, self.window)].tolist()
        if not last:
            ends.pop()  # opened again in the next block
        lo, doc, doc_ends, raw = 0, 0, self.ends.tolist(), self.ids.tobytes()
        first = 0  # where document `doc` begins
        for hi in ends:
            padded = padded_length(hi - lo, self.window)
            p = lo
            while p < hi:
                q = min(hi, doc_ends[doc])
                d, before, whole = self.owner[doc]
                self.out.append((d, before + p - first, q - p, zlib.crc32(raw[4 * p : 4 * q]), whole, self.sequence, p - lo, padded))
                if q == doc_ends[doc]:
                    doc += 1
                    first = q
                p = q
            self.sequence += 1
            lo = hi
        rest = self.owner[doc:]
        if rest and lo > first:
            d, before, whole = rest[0]
            rest[0] = (d, before + lo - first, whole)
        self.owner, self.ends, self.ids = rest, self.ends[doc:] - lo, self.ids[lo:]
        self.sentences = self.sentences[np.searchsorted(self.sentences, lo, "right") :] - lo

    def take(self) -> pa.RecordBatch | None:
        if not self.out:
            return None
        cols, self.out = list(zip(*self.out)), []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack(docs: DataFrame, path: str = "", window: int = WINDOW, end: int = 1, sentence_cost: int = 16, run: int = 64, run_cost: int = 256, block: int = 1 << 19) -> DataFrame:
    """One row for each piece: a range of a document's ids and its place in a sequence. No shuffle; the order
    is that of the rows within their partitions, and sequence ids are a partition's number and a counter."""
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    if run > window:
        raise ValueError("run must not exceed the window")

    def run_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("encode")
        from pyspark import TaskContext

        encoder = ChunkEncoder.at(path)
        packer = _Packer(TaskContext.get().partitionId(), window, sentence_cost, run, run_cost)
        for batch in steps(batches, limit=4 << 20):
            ids, ptr, sentences = encoder.encode_closed(batch.column("text"), end, marked=True)
            doc_ids = batch.column("doc_id").to_pylist()
            lo = 0
            while lo < len(doc_ids):
                hi = max(lo + 1, int(np.searchsorted(ptr, ptr[lo] + block, "right")) - 1)
                own = slice(*np.searchsorted(sentences, [ptr[lo] + 1, ptr[hi]]).tolist())
                packer.add(doc_ids[lo:hi], ids[ptr[lo] : ptr[hi]], ptr[lo : hi + 1] - ptr[lo], sentences[own] - ptr[lo])
                packer.pack(last=False)
                lo = hi
            if (out := packer.take()) is not None:
                yield out
        packer.pack(last=True)
        if (out := packer.take()) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run_partition, PIECES)
