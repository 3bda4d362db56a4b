"""Token ids in binary shards, compressed by Re-Pair grammars, with random access to each document.

A shard file is a sequence of blocks. A block holds about BLOCK ids of whole documents and a grammar of its
own: rounds of counting the adjacent pairs inside documents and replacing the frequent ones (the most frequent `per_round` of
a round), left to right without overlap, by new symbols (nonterminals), until no pair occurs `least` times or symbols run out.
Symbols fit 16 bits while the vocabulary leaves room, else 32. Stored are the rules (pairs of symbols), each
symbol's expansion length, the documents' ids, symbol offsets and id counts, and the symbols.

    file:   magic "RPG1", blocks, index of block offsets (u64 each), block count u64, magic "RPG1"
    block:  header (u64 x 6: documents, symbols, rules, base, ids, symbol bytes), rules u32 x 2, expansion
            lengths u32, doc_ids i64, null flags u8, symbol offsets u64, id counts u64, symbols u16 or u32

Nulls and empty texts: the end id alone. Null doc_ids sort first. Equal doc_ids: in any order, ids
contiguous all the same. Files are written under another name and renamed, so that repeated tasks are safe.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcintel.llm.bpe import ChunkEncoder, tokenizer_path
from srcintel.llm.shared import fresh, ship, stash
from srcintel.llm.text import enter, steps

MAGIC = b"RPG1"
BLOCK = 2 << 20
ENCODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: Bins that pairs are counted in first, by hash: a pair as frequent as is asked for lies in a bin that is.
BINS = 20


def _frequent(key: np.ndarray, bin_: np.ndarray, least: int, most: int) -> np.ndarray:
    """The keys that occur `least` times or more, ascending; of more than `most`, the most frequent; at most one of a bin (the others'
    turn comes in the next round)."""
    key = np.sort(key[(np.bincount(bin_, minlength=1 << BINS) >= least)[bin_]])
    if not len(key):
        return key
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    often = np.flatnonzero(count >= least)
    often = often[np.argsort(-count[often], kind="stable")]
    often = often[np.sort(np.unique(_bin(key[first[often]]), return_index=True)[1])]
    return np.sort(key[first[often[:most]]])


def _bin(key: np.ndarray) -> np.ndarray:
    return ((key * key.dtype.type(0x9E3779B1 if key.itemsize == 4 else 0x9E3779B97F4A7C15)) >> key.dtype.type(8 * key.itemsize - BINS)).astype(np.int32)


def grammar(ids: np.ndarray, last: np.ndarray, base: int, least: int = 8, per_round: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, position flags of the documents' last symbols). last: true at each document's last id.
    Symbol base + k stands for the pair rules[k]. Rounds go on until no pair occurs `least` times (a rule takes 12 bytes and
    saves 2 or 4 at each occurrence) or symbols run out: those of 16 bits where the vocabulary leaves some, else a million."""
    seq, rules = ids.astype(np.uint32), []
    room = 65536 - base if base < 65536 else 1 << 20
    n_rules = 0
    while len(seq) > 1 and n_rules < room:
        often = np.bincount(seq) >= least
        n_often = int(often.sum())
        rank = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)[seq]
        at = np.flatnonzero((rank[:-1] >= 0) & (rank[1:] >= 0) & ~last[:-1])
        kind = np.uint32 if n_often < 65536 else np.uint64
        key = rank[at].astype(kind) * kind(n_often) + rank[at + 1].astype(kind)
        bin_ = _bin(key)
        chosen = _frequent(key, bin_, least, min(per_round, room - n_rules))
        if not len(chosen):
            break
        rule_of = np.zeros(1 << BINS, np.int32)
        rule_of[_bin(chosen)] = np.arange(len(chosen))
        rule = rule_of[bin_]
        hit = chosen[rule] == key
        at, rule = at[hit], rule[hit]
        # left to right without overlap: of a run of adjacent hits, every other one
        new_run = np.r_[True, np.diff(at) != 1]
        begun = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - begun) % 2 == 0
        at, rule = at[keep], rule[keep]
        # a pair that mostly overlapped others may be left with less: its turn is over all the same, and its rule stays if it is used
        used = np.bincount(rule, minlength=len(chosen)) > 0
        number = np.cumsum(used) - 1
        symbol = np.flatnonzero(often).astype(np.uint32)
        pair = np.stack([symbol[chosen // kind(n_often)], symbol[chosen % kind(n_often)]], 1)
        seq[at] = base + n_rules + number[rule]
        last[at] = last[at + 1]
        left = np.ones(len(seq), bool)
        left[at + 1] = False
        seq, last = seq[left], last[left]
        rules.append(pair[used])
        n_rules += int(used.sum())
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), last


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal stands for. A rule's symbols are older than it, a round at a time."""
    size = np.zeros(len(rules), np.uint32)
    known = np.zeros(len(rules), bool)
    while not known.all():
        length, sure = np.zeros(len(rules), np.uint32), np.ones(len(rules), bool)
        for side in rules.T:
            own = side >= base
            k = np.where(own, side - np.uint32(base), 0).astype(np.int64)
            length += np.where(own, size[k], 1).astype(np.uint32)
            sure &= ~own | known[k]
        size[sure], known = length[sure], known | sure
    return size


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for; a pass for each level of the grammar."""
    seq = seq.astype(np.uint32)
    while True:
        own = seq >= base
        if not own.any():
            return seq
        at = np.arange(len(seq)) + np.cumsum(own) - own
        out = np.empty(len(seq) + int(own.sum()), np.uint32)
        out[at] = seq
        pair = rules[seq[own] - np.uint32(base)]
        out[at[own]], out[at[own] + 1] = pair[:, 0], pair[:, 1]
        seq = out


def expand_block(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, n_ids: int) -> np.ndarray:
    """The same for a whole block: each rule is expanded once, and a symbol copies its rule's ids."""
    size = lengths.astype(np.int64)
    if int(size.sum()) > 4 * n_ids + 1024:  # rules of rules of rules, longer together than the block
        return expand(seq, rules, base)
    flat = expand(base + np.arange(len(rules), dtype=np.uint32), rules, base)
    first = np.cumsum(size) - size
    own = seq >= base
    rule = np.where(own, seq, base).astype(np.int64) - base
    if not len(rules):
        return seq.astype(np.uint32)
    each = np.where(own, size[rule], 1)
    stop = np.cumsum(each)
    # a plain symbol takes its id from the end of `flat`, which the plain ones are put to
    plain = seq[~own].astype(np.uint32)
    begin = np.where(own, first[rule], len(flat) + np.cumsum(~own) - 1)
    return np.concatenate([flat, plain])[np.repeat(begin - (stop - each), each) + np.arange(int(stop[-1]) if len(stop) else 0)]


def block_bytes(doc_ids: list, ids: np.ndarray, ptr: np.ndarray, base: int, **how) -> bytes:
    last = np.zeros(len(ids), bool)
    last[ptr[1:] - 1] = True
    seq, rules, last = grammar(ids, last, base, **how)
    offset = np.r_[0, np.flatnonzero(last) + 1].astype(np.uint64)
    wide = 2 if base + len(rules) <= 65536 else 4
    head = struct.pack("<6Q", len(doc_ids), len(seq), len(rules), base, len(ids), wide)
    null = np.array([d is None for d in doc_ids], np.uint8)
    body = [rules.astype("<u4"), expansion_lengths(rules, base).astype("<u4"), np.array([d or 0 for d in doc_ids], "<i8"), null, offset.astype("<u8"), np.diff(ptr).astype("<u8"), seq.astype(f"<u{wide}")]
    return head + b"".join(x.tobytes() for x in body)


class Block:
    """A block in a file's bytes (or a memory map of them)."""

    def __init__(self, raw: memoryview | bytes, at: int):
        docs, symbols, n_rules, self.base, self.n_ids, wide = struct.unpack_from("<6Q", raw, at)
        at += 48

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.rules = part("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths, self.ids, self.null = part("<u4", n_rules), part("<i8", docs), part("u1", docs)
        self.offset, self.size, self.symbols = part("<u8", docs + 1), part("<u8", docs), part(f"<u{wide}", symbols)

    def doc(self, k: int) -> np.ndarray:
        """Document k's ids, decoded alone."""
        return expand(self.symbols[int(self.offset[k]) : int(self.offset[k + 1])], self.rules, self.base)

    def slice(self, k: int, lo: int, hi: int) -> np.ndarray:
        """Ids lo:hi of document k: the expansion lengths tell which symbols hold them, and only those are expanded."""
        seq = self.symbols[int(self.offset[k]) : int(self.offset[k + 1])].astype(np.int64)
        size = np.ones(len(seq), np.int64)
        own = seq >= self.base
        size[own] = self.lengths[seq[own] - self.base]
        end = np.cumsum(size)
        a, b = int(np.searchsorted(end, lo, "right")), int(np.searchsorted(end, hi, "left")) + 1
        skip = lo - int(end[a - 1] if a else 0)
        return expand(seq[a:b], self.rules, self.base)[skip : skip + hi - lo]


def blocks(raw: bytes | memoryview) -> list[Block]:
    if bytes(raw[:4]) != MAGIC or bytes(raw[-4:]) != MAGIC:
        raise ValueError("not a whole shard file")
    (n,) = struct.unpack_from("<Q", raw, len(raw) - 12)
    return [Block(raw, at) for at in struct.unpack_from(f"<{n}Q", raw, len(raw) - 12 - 8 * n)]


def write_shards(docs: DataFrame, to: str, path: str = "", end: int = 1, base: int = 0, **how) -> DataFrame:
    """Writes a shard file for each range of doc_ids, ascending; a row for each: shard, path, documents, ids, bytes."""
    spark = docs.sparkSession
    ship(spark)
    path = path or tokenizer_path()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("encode")
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = ChunkEncoder.at(path)
        first = base or len(encoder.ends)
        name = f"{to}/shard-{shard:06d}.rpg"
        part = f"{name}.{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        with open(part, "wb") as f:
            f.write(MAGIC)
            at: list[int] = []
            for batch in steps(batches, limit=5 << 20):
                ids, ptr = encoder.encode_closed(batch.column("text"), end)
                doc_ids = batch.column("doc_id").to_pylist()
                lo = 0
                while lo < len(doc_ids):
                    hi = max(lo + 1, int(np.searchsorted(ptr, ptr[lo] + BLOCK, "right")) - 1)
                    at.append(f.tell())
                    f.write(block_bytes(doc_ids[lo:hi], ids[ptr[lo] : ptr[hi]], ptr[lo : hi + 1] - ptr[lo], first, **how))
                    lo = hi
                n_docs, n_ids = n_docs + len(doc_ids), n_ids + len(ids)
            f.write(struct.pack(f"<{len(at)}Q", *at) + struct.pack("<Q", len(at)) + MAGIC)
            size = f.tell()
        os.replace(part, name)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "documents": [n_docs], "ids": [n_ids], "bytes": [size]})

    sorted_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return sorted_docs.mapInArrow(run, "shard long, path string, documents long, ids long, bytes long")


def read_shards(shards: DataFrame) -> DataFrame:
    """Each document of the shard files, with its ids' place in the whole and their crc32, from the files alone."""
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    placed = shards.withColumn("before", F.coalesce(F.sum("ids").over(w), F.lit(0).cast("long"))).select("path", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("encode")
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                for b in blocks(np.memmap(path, np.uint8, "r").data):
                    raw = expand_block(b.symbols, b.rules, b.lengths, b.base, b.n_ids).tobytes()
                    size = b.size.astype(np.int64)
                    stop = np.cumsum(size)
                    crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(size.tolist(), stop.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(b.ids.astype(np.int64), pa.int64(), mask=b.null.astype(bool)), pa.array(start + stop - size), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(stop[-1])

    n = max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(n, "path").mapInArrow(run, ENCODED)


def encode(docs: DataFrame, **how) -> DataFrame:
    """Writes the files and reads them back."""
    spark = docs.sparkSession
    return read_shards(stash(write_shards(docs, fresh(spark, "token-shards"), **how), "shards"))
