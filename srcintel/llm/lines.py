"""Fuzzy line deduplication: MinHash bands of normalised lines, edit similarity, connected groups.

A line's normal form keeps its letters and digits: A-Z and the capitals of Latin-1 in lower case, all other ASCII and
Latin-1 signs blank, other scripts as they are; its words are what blanks part. Lines of `min_chars` characters or more in
normal form take part (by default all that have one); equal normal forms (64 bits of hash) are one item. Two items are linked
when their edit similarity, 1 - Levenshtein / longer length, is at least `least`. Candidates are lines that share a
bucket: BANDS bands of ROWS minima of the hashes of their runs of GRAM bytes. A pair with a share J of its runs in common
meets with probability 1 - (1 - J^ROWS)^BANDS; lengths and 28 other minima then tell most chance meetings. (SimHashes joined
on pigeonhole blocks were measured first and miss most edited lines: see the README, which also gives the recall against brute force.)
Of each connected group of lines over all documents one occurrence stays: that of the least (doc_id, row key, line
number). The others are cut out of their documents.

One pass over the texts sends, by ranges of their keys, the least occurrence of each of a step's lines and its buckets'
members, as arrays; the merging keeps only the least occurrence of each line, so a line that a third of the corpus shares is
no hot group. A bucket of more than links.CELL lines is split into salted cells. Only the texts of lines with a near
neighbour are fetched, by a second pass, and compared where their component comes together (links.verified).

Documents left without any word, after they had some, are dropped by dedup(); all other rows stay, with all their
columns, whatever these are called. Nulls and empty texts stay as they are. Rows equal in all columns are one document
given twice: both keep the same lines. A null doc_id sorts last.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcintel.llm import keyset, links
from srcintel.llm.shared import keyed, named, ship, stash, tasks
from srcintel.llm.text import U, as_bytes, enter, mix, range_hash, runs, steps

RANGES = 4  # for each shuffle partition
OCCURRENCE = np.dtype([("key", "<u8"), ("none", "u1"), ("doc", "<i8"), ("k1", "<i8"), ("k2", "<i8"), ("line", "<i4")])
ORDER = ["key", "none", "doc", "k1", "k2", "line"]
#: A line in a bucket: the bucket's lower 32 bits (the upper ones choose the range).
MEMBER = np.dtype([("low", "<u4"), ("key", "<u8"), ("signature", "<u8")])
CUT = np.dtype([("_k1", "<i8"), ("_k2", "<i8"), ("line", "<i4")])
MET = np.dtype([("run", "<i8"), ("key", "<i8")])
ITEMS, CUTS, CELLS, CROWD = range(4)
GRAM = 6  # bytes
BANDS, ROWS = 16, 4
REGISTERS = BANDS * ROWS
AGREE = 11
PROMISE = 0.4  # share of the registers in which two lines agree, to be compared
#: A run of so many registers, in the order of a line, that don't agree is a part that the other line doesn't have, with so many edits a character.
FOREIGN, EDITS = 8, 0.64
LOG_STEPS = 12  # of length, for each doubling
CHUNK = 512 << 10  # bytes of text whose lines are hashed at once, so that the arrays stay in the caches
HELD = 12_000  # lines that a task gathers before it sends them on, sorted
SMALL = 16  # lines of a bucket up to which those without a near one in it are told where the bucket is put together
_NONE = np.uint32(0xFFFFFFFF)
_COIN = (mix(np.arange(1, REGISTERS + 1, dtype=U)) & U(1)).astype(bool)
_RING = np.argsort(mix(np.arange(1000, 1000 + REGISTERS, dtype=U)))  # the registers in an order of their own, so that those of a band aren't neighbours

_SHOWN = np.full(256, 32, np.uint8)
_SHOWN[48:58] = np.arange(48, 58)
_SHOWN[97:123] = np.arange(97, 123)
_SHOWN[65:91] = np.arange(97, 123)
_SHOWN[128:] = np.arange(128, 256)


def shown(data: np.ndarray) -> np.ndarray:
    """The normal form's bytes, blanks for what it leaves out."""
    out = _SHOWN[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    capital = lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1
    out[capital] += 0x20
    sign = lead[(second == 0x97) | (second == 0xB7)]
    sign = np.concatenate([sign, np.flatnonzero(data[:-1] == 0xC2)])
    out[sign] = out[sign + 1] = 32
    return out


class Lines:
    """The lines of a text column that take part."""

    def __init__(self, col: pa.Array, min_chars: int):
        data, off = as_bytes(col)
        self.form = shown(data) if len(data) else data
        ends = np.flatnonzero(data == 10)
        # a line is between line ends, within its text
        bound = np.sort(np.concatenate([off[:-1], ends + 1]), kind="stable")
        text = np.searchsorted(off[1:-1], bound, "right") if len(off) > 2 else np.zeros(len(bound), np.int64)
        fresh = np.zeros(len(bound), bool)
        # starts that coincide belong to empty texts and lines; the last is that of the text with words
        fresh[np.searchsorted(bound, off[:-1], "right") - 1] = True
        begun = np.maximum.accumulate(np.where(fresh, np.arange(len(bound)), 0))
        number = np.arange(len(bound)) - begun
        breaks = np.append(bound, len(data))
        start, end, ptr = runs(self.form != 32, breaks)
        n = np.diff(ptr)
        # characters, not bytes, so that the minimum is the same in all scripts
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=before[1:])
        length = np.zeros(len(end) + 1, np.int64)
        np.cumsum(before[end] - before[start], out=length[1:])
        size = length[ptr[1:]] - length[ptr[:-1]] + np.maximum(0, n - 1)
        keep = (size >= min_chars) & (n > 0)
        self.text, self.number = text[keep], number[keep]
        inside = np.repeat(keep, n)
        self.start, self.end = start[inside], end[inside]
        self.word = range_hash(self.form, self.start, self.end)
        n = n[keep]
        self.first = np.cumsum(n) - n
        # an order-sensitive hash of the words
        place = np.arange(len(self.word)) - np.repeat(self.first, n)
        self.key = mix(np.add.reduceat(mix(self.word + place.astype(U) * U(0x9E3779B97F4A7C15)), self.first)) if len(n) else np.zeros(0, U)

    def text_of(self, k: int) -> str:
        stop = self.first[k + 1] if k + 1 < len(self.first) else len(self.start)
        raw = self.form[self.start[self.first[k]] : self.end[stop - 1]].tobytes()
        return b" ".join(raw.split()).decode("utf-8", "replace")


def _parts(records: np.ndarray, by: str, ranges: int) -> pa.RecordBatch | None:
    """Records sorted by a key as a row for each range of it."""
    bound = [0, *np.searchsorted(records[by], np.array([((r << 64) // ranges) for r in range(1, ranges)], U)).tolist(), len(records)]
    rows = [(r, records[a:b].tobytes()) for r, (a, b) in enumerate(zip(bound, bound[1:])) if b > a]
    if not rows:
        return None
    part, raw = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(raw, pa.binary())], ["part", "records"])


def _least(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the least occurrence of each key, ascending by key; all others, but for the same place in a row given twice)."""
    records = records[np.lexsort([records[c] for c in reversed(ORDER)])]
    first = np.ones(len(records), bool)
    first[1:] = records["key"][1:] != records["key"][:-1]
    kept = records[first]
    own = kept[np.cumsum(first) - 1]
    return kept, records[(records["k1"] != own["k1"]) | (records["k2"] != own["k2"]) | (records["line"] != own["line"])]


def _blob(kind: int, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(records), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([records[lo : lo + 100_000].tobytes()], pa.binary())], ["kind", "records"])


def _cut(gone: np.ndarray) -> np.ndarray:
    out = np.zeros(len(gone), CUT)
    out["_k1"], out["_k2"], out["line"] = gone["k1"], gone["k2"], gone["line"]
    return out


def grams(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each run of GRAM bytes, how many each line has, each line's length in characters), over lines whose words are parted and framed by one blank."""
    n_words = np.diff(np.append(lines.first, len(lines.start)))
    step = np.zeros(len(lines.form) + 1, np.int8)
    step[lines.start] += 1
    step[lines.end] -= 1
    inside = np.cumsum(step, dtype=np.int8)[:-1].astype(bool)
    stop = np.cumsum(lines.end - lines.start + 1)  # the blank after each word; one is before the first word
    buf = np.full(int(stop[-1]) + 1 + 16, 32, np.uint8)
    filled = np.ones(int(stop[-1]) + 1, bool)
    filled[0] = filled[stop] = False
    buf[: len(filled)][filled] = lines.form[inside]
    begin = np.append(0, stop)[lines.first]
    size = np.append(0, stop)[lines.first + n_words] + 1 - begin
    letters = np.add.reduceat(((buf[: len(filled) - 1] & 0xC0) != 0x80).astype(np.int64), begin) - 1
    value = np.empty(-(-len(filled) // 8) * 8, U)
    for k in range(8):
        raw = buf[k : k + (len(buf) - k) // 8 * 8].view("<u8")
        value[k::8] = raw[: len(value) // 8]
    n = np.maximum(1, size - GRAM + 1)
    owner = np.cumsum(n) - n
    value = value[np.repeat(begin - owner, n) + np.arange(int(n.sum()))] & U((1 << 8 * GRAM) - 1)
    short = np.flatnonzero(size < GRAM)
    value[owner[short]] &= (U(1) << (U(8) * size[short].astype(U))) - U(1)
    value *= U(0x9E3779B97F4A7C15)
    value ^= value >> U(32)
    value *= U(0xD6E8FEB86659FD93)
    return value, n, letters


def minima(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lines x REGISTERS: the least hash of those that fall to each register; an empty register takes that of the next one that has any, to the left or right on a
    ring by its own coin (Shrivastava and Li 2014), so that two lines agree on a register as often as their sets overlap."""
    out = np.full(len(n) * REGISTERS, _NONE, np.uint32)
    np.minimum.at(out, np.repeat(np.arange(len(n)) * REGISTERS, n) + (hashes >> U(58)).astype(np.int64), (hashes & U(0xFFFFFFFE)).astype(np.uint32) >> np.uint32(1))
    return _filled(out.reshape(-1, REGISTERS), _NONE)


def _filled(out: np.ndarray, none) -> np.ndarray:
    empty = out == none
    some = np.flatnonzero(empty.any(1))
    if len(some):
        full = np.tile(~empty[some][:, _RING], 2)  # twice around, so that the ends meet
        at = np.arange(2 * REGISTERS, dtype=np.int16)
        left = np.maximum.accumulate(np.where(full, at, -1), axis=1)[:, REGISTERS:]
        right = np.minimum.accumulate(np.where(full, at, 2 * REGISTERS)[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS]
        source = np.empty(left.shape, np.intp)
        source[:, _RING] = _RING[np.where(empty[some][:, _RING], np.where(_COIN, left, right), at[:REGISTERS]) % REGISTERS]
        out[some] = np.take_along_axis(out[some], source, axis=1)
    return out


def bands(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each line and band, signature of the same). A signature has the length's logarithm in its upper 8 bits, and
    2 bits each of 28 registers, none of which belong to the band."""
    hashes, n, letters = grams(lines)
    least = minima(hashes, n)
    pair = np.ascontiguousarray(least).view("<u8").reshape(-1, BANDS, ROWS // 2)
    bucket = np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    for k in range(ROWS // 2):
        bucket = mix(bucket + pair[:, :, k])
    length = np.minimum(255, np.floor(LOG_STEPS * np.log2(np.maximum(1, letters)))).astype(U) << U(56)
    half = (least & np.uint32(3)).astype(U).reshape(-1, 2, REGISTERS // 2)[:, :, :28]
    half = np.bitwise_or.reduce(half << (U(2) * np.arange(28, dtype=U)), axis=2) | length[:, None]
    return bucket, np.repeat(half[:, ::-1], BANDS // 2, axis=1)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether signatures may be of lines of edit similarity `least`: the lengths allow it, and AGREE of 28 registers agree."""
    x = a ^ b
    gap = np.abs((a >> U(56)).astype(np.int64) - (b >> U(56)).astype(np.int64))
    return (np.bitwise_count((x | x >> U(1)) & U(0x0055555555555555)) <= 28 - AGREE) & (gap <= math.ceil(-LOG_STEPS * math.log2(least)))


def spread(docs: DataFrame, min_chars: int, ranges: int) -> DataFrame:
    """part, records: what each step has for each range: parts 0 to ranges - 1 the least occurrences of its lines by range of the key, the next
    `ranges` the members of buckets by range of the bucket, one more for occurrences that go for sure."""
    ship(docs.sparkSession)

    def out(places: list[np.ndarray], members: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        kept, gone = _least(np.concatenate(places))
        yield _parts(kept, "key", ranges)
        if len(gone):
            # with no range of their own: anywhere will do
            yield pa.RecordBatch.from_arrays([pa.array([2 * ranges + int(gone["key"][0] % U(ranges))], pa.int32()), pa.array([_cut(gone).tobytes()], pa.binary())], ["part", "records"])
        key, bucket, signature = (np.concatenate([m[k] for m in members]) for k in range(3))
        _, once = np.unique(key, return_index=True)
        bucket, signature = bucket[once].ravel(), signature[once].ravel()
        part = ((bucket >> U(32)) * U(ranges)) >> U(32)
        order = np.argsort(part.astype(np.uint16 if ranges < 1 << 16 else np.uint32), kind="stable")
        records = np.zeros(len(order), MEMBER)
        records["low"], records["key"], records["signature"] = bucket[order].astype(np.uint32), np.repeat(key[once], BANDS)[order], signature[order]
        cut = np.searchsorted(part[order], np.arange(ranges + 1, dtype=U)).tolist()
        some = [r for r in range(ranges) if cut[r + 1] > cut[r]]
        yield pa.RecordBatch.from_arrays([pa.array([ranges + r for r in some], pa.int32()), pa.array([records[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary())], ["part", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lines")
        places, members, held = [], [], 0
        for batch in steps(batches, limit=CHUNK):
            lines = Lines(batch.column("text"), min_chars)
            if not len(lines.key):
                continue
            doc = batch.column("doc_id")
            records = np.zeros(len(lines.key), OCCURRENCE)
            records["key"], records["line"] = lines.key, lines.number
            for name, values in (("none", doc.is_null().to_numpy(zero_copy_only=False)), ("doc", doc.fill_null(0).to_numpy(zero_copy_only=False)), ("k1", batch.column("_k1").to_numpy()), ("k2", batch.column("_k2").to_numpy())):
                records[name] = values[lines.text]
            places.append(records)
            members.append((lines.key, *bands(lines)))
            held += len(lines.key)
            if held > HELD:
                yield from out(places, members)
                places, members, held = [], [], 0
        if held:
            yield from out(places, members)

    return docs.mapInArrow(run, "part int, records binary")


def _meet(records: np.ndarray, part: int, near, small: int) -> tuple[np.ndarray, np.ndarray]:
    """(members of buckets that hold near lines, members of buckets too large for one task) of a range of buckets. The run that stands for a
    bucket is a hash of its members, so that the same lines met in several bands are one."""
    low, key, signature = (np.ascontiguousarray(records[c]) for c in ("low", "key", "signature"))
    order = np.argsort(low.astype(U) << U(32) | key >> U(32))
    low, key, signature = low[order], key[order], signature[order]
    # a line comes from each step that has it; the keys of a bucket ascend but for their lower halves
    once = np.append(True, (low[1:] != low[:-1]) | (key[1:] != key[:-1]))
    low, key, signature = low[once], key[once], signature[once]
    run = np.cumsum(np.append(True, low[1:] != low[:-1])) - 1
    size = np.bincount(run)[run]
    stays = (size > small) & (size <= links.CELL)
    some = np.flatnonzero((size > 1) & (size <= small))
    at, s = run[some], signature[some]
    for d in range(1, small):
        i = np.flatnonzero(at[:-d] == at[d:])
        if not len(i):
            break
        i = i[near(s[i], s[i + d])]
        stays[some[i]] = stays[some[i + d]] = True
    many = size > links.CELL
    crowd = np.zeros(int(many.sum()), MET)
    crowd["run"], crowd["key"] = (np.int64(part) << 32) | low[many].astype(np.int64), key[many].view(np.int64)
    key, run = key[stays], run[stays]
    out = np.zeros(len(key), MET)
    if len(key):
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        out["run"] = np.repeat(np.add.reduceat(mix(key ^ U(0x5851F42D4C957F2D)), first), np.diff(np.append(first, len(key)))).view(np.int64)
    out["key"] = key.view(np.int64)
    return out, crowd


def merged(spread_: DataFrame, ranges: int, least: float, small: int = SMALL) -> DataFrame:
    """kind, records: over the whole corpus the distinct lines' least occurrences (ITEMS), the occurrences that go (CUTS), the
    members of buckets with near lines (CELLS), and those of crowded buckets (CROWD)."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return alike(b, a, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lines")
        part, held, size = None, [], 0

        def reduce() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            kept, gone = _least(np.concatenate(held))
            held, size = [kept], 0
            yield from _blob(CUTS, _cut(gone))

        def close() -> Iterator[pa.RecordBatch]:
            if part is None or part >= 2 * ranges:
                return
            if part < ranges:
                yield from reduce()
                yield from _blob(ITEMS, held[0])
            else:
                met, crowd = _meet(np.concatenate(held), part - ranges, near, small)
                yield from _blob(CELLS, met)
                yield from _blob(CROWD, crowd)

        for b in batches:
            for p, raw in zip(b.column("part").to_pylist(), b.column("records").to_pylist()):
                if p != part:
                    yield from close()
                    part, held, size = p, [], 0
                if p >= 2 * ranges:
                    yield from _blob(CUTS, np.frombuffer(raw, CUT))
                    continue
                held.append(np.frombuffer(raw, OCCURRENCE if p < ranges else MEMBER))
                size += len(held[-1])
                if p < ranges and size > 500_000:
                    yield from reduce()
        yield from close()

    n = tasks(spread_.sparkSession)
    return spread_.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, "kind int, records binary")


def _rows(blobs: DataFrame, kind: int, record: np.dtype) -> DataFrame:
    """The records of one kind as rows."""
    kinds = {"<i8": "long", "<i4": "int"}
    names = list(record.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("records").to_pylist():
                r = np.frombuffer(raw, record)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[c])) for c in names], names)

    return blobs.where(F.col("kind") == kind).select("records").mapInArrow(run, ", ".join(f"{c} {kinds[record[c].str]}" for c in names))


def sketches(forms: list[str]) -> list[bytes]:
    """Of each normal form: a byte of each register's minimum, the registers in the order of their minima's places in the line, and the length."""
    if not forms:
        return []
    hashes, n, letters = grams(Lines(pa.array(forms, pa.string()), 1))
    place = np.arange(len(hashes), dtype=U) - np.repeat(np.cumsum(n) - n, n).astype(U)
    least = np.full(len(n) * REGISTERS, ~U(0))
    np.minimum.at(least, np.repeat(np.arange(len(n)) * REGISTERS, n) + (hashes >> U(58)).astype(np.int64), (hashes & U(0xFFFFFFFE)) << U(31) | place)
    least = _filled(least.reshape(-1, REGISTERS), ~U(0))
    out = np.zeros((len(n), 2 * REGISTERS + 4), np.uint8)
    out[:, :REGISTERS] = (least >> U(32)).astype(np.uint8)
    out[:, REGISTERS : 2 * REGISTERS] = np.argsort(least & U(0xFFFFFFFF), axis=1, kind="stable")
    out[:, 2 * REGISTERS :] = letters.astype("<u4").view(np.uint8).reshape(-1, 4)
    raw, width = out.tobytes(), out.shape[1]
    return [raw[k * width : (k + 1) * width] for k in range(len(n))]


def _foreign(same: np.ndarray) -> np.ndarray:
    """How many registers lie in runs of FOREIGN or more that don't agree. same: in the order of the line."""
    u = ~np.packbits(same, axis=1, bitorder="little").view("<u8")[:, 0]
    u &= u >> U(1)
    u &= u >> U(2)
    u &= u >> U(4)  # where FOREIGN begin
    u |= u << U(1)
    u |= u << U(2)
    u |= u << U(4)  # all places of such runs
    return np.bitwise_count(u).astype(np.float32)


def promise(a: np.ndarray, b: np.ndarray, least: float, enough: float = 0.0) -> np.ndarray:
    """The share of registers in which sketches agree, row by row; -1 where edit similarity of `least` isn't to be expected: by the lengths, or because a
    large part of either line is foreign to the other (lines of different texts that share a passage). Less than `enough` is -1, too."""
    same = a[:, :REGISTERS] == b[:, :REGISTERS]
    size = [np.ascontiguousarray(x[:, 2 * REGISTERS :]).view("<u4")[:, 0].astype(np.int64) for x in (a, b)]
    longer = np.maximum(*size)
    share = np.bitwise_count(np.packbits(same, axis=1).view("<u8")[:, 0]) / REGISTERS
    # only what is left by now is put in the order of the lines
    some = np.flatnonzero((np.minimum(*size) >= least * longer - 1e-9) & (share >= enough))
    foreign, left = np.zeros(len(some)), same[some]
    for x, n in zip((a, b), size):
        own = np.take_along_axis(left, x[some, REGISTERS : 2 * REGISTERS].astype(np.intp), axis=1)
        foreign = np.maximum(foreign, _foreign(np.ascontiguousarray(own)) * n[some] / (REGISTERS * longer[some]))
    out = np.full(len(a), -1.0)
    some = some[foreign * EDITS <= 1 - least]
    out[some] = share[some]
    return out


def promises_of_all(a: np.ndarray, least: float, b: np.ndarray | None = None, enough: float = 0.0) -> np.ndarray:
    """promise() of all sketches to one another, or to those of b."""
    every = [a] if b is None else [a, b]
    size = [np.ascontiguousarray(x[:, 2 * REGISTERS :]).view("<u4")[:, 0].astype(np.float32) for x in every]
    register = [np.ascontiguousarray(x[:, :REGISTERS]) for x in every]
    longer = np.maximum(size[0][:, None], size[-1])
    fits = np.minimum(size[0][:, None], size[-1]) >= least * longer - 1e-6
    agree, foreign = np.zeros(fits.shape, np.float32), []
    for x in range(len(every)):
        order, other = every[x][:, REGISTERS : 2 * REGISTERS].astype(np.intp), register[x - 1]
        foreign.append(np.zeros((len(order), len(other)), np.float32))
        for i in range(len(order)):
            some = np.flatnonzero(fits.T[i] if x else fits[i])
            if not x and len(some):
                same = other[some] == register[x][i]
                agree[i, some] = n = np.bitwise_count(np.packbits(same, axis=1).view("<u8")[:, 0])
                near = n >= enough * REGISTERS
                fits[i, some[~near]] = False
                some, same = some[near], same[near]
            else:
                same = other[some] == register[x][i]
            # only what is left by now is put in the order of the line
            foreign[x][i, some] = _foreign(np.take(same, order[i], axis=1)) * size[x][i]
    fits &= np.maximum(foreign[0], foreign[-1].T) * (EDITS / REGISTERS) <= (1 - least) * longer
    return np.where(fits, agree / REGISTERS, -1.0)


def contents(docs: DataFrame, keys: DataFrame, min_chars: int) -> DataFrame:
    """(key, form, signature) of the lines with these keys, from another pass over the texts that a mapped set of keys filters. signature: the sketch."""
    folder = keyset.write(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lines")
        wanted, sent = keyset.KeySet(folder), set()
        for batch in steps(batches, limit=CHUNK):
            lines = Lines(batch.column("text"), min_chars)
            key, at = np.unique(lines.key, return_index=True)
            at = at[wanted.contains(key)] if len(key) else at
            if len(sent) > HELD:
                sent.clear()
            at = at[[k not in sent for k in lines.key[at].tolist()]]  # what this task has sent lately isn't sent again
            sent.update(lines.key[at].tolist())
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(lines.key[at].view(np.int64)), pa.array([lines.text_of(int(k)) for k in at], pa.string())], ["key", "form"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lines")
        for batch in steps(batches, "form", CHUNK):
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("form"), pa.array(sketches(batch.column("form").to_pylist()), pa.binary())], ["key", "form", "signature"])

    found = docs.select("text").mapInArrow(run, "key long, form string").groupBy("key").agg(F.first("form").alias("form"))
    return found.mapInArrow(add, "key long, form string, signature binary")


# --- edit similarity ---------------------------------------------------------------------------------------


def _stripped(a: str, b: str) -> tuple[str, str]:
    """Without the common beginning and end."""
    for _ in range(2):
        low, high = 0, min(len(a), len(b))
        if a[:high] == b[:high]:
            low = high
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
        a, b = a[low:][::-1], b[low:][::-1]
    return a, b


def distance(a: str, b: str, most: int) -> int:
    """The Levenshtein distance, or more than `most` where it is more: a column of the table at a time, as the bits of integers (Myers 1999).
    Every 64 columns the least entry of the column, with what its place still costs, tells whether there is a way on."""
    a, b = _stripped(a, b)
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if not a or n - m > most:
        return n
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    find, check = where.get, m > 128
    for k, c in enumerate(b, 1):
        equal = find(c, 0)
        horizontal = (((equal & up) + up) ^ up) | equal | down
        plus = down | (horizontal | up) ^ full
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full | 1
        vertical = equal | down
        up = minus << 1 & full | (vertical | plus) ^ full
        down = plus & vertical
        if check and not k & 63:
            size = (m + 7) // 8
            bits = [np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), count=m, bitorder="little").astype(np.int32) for x in (up, down)]
            column = k + np.cumsum(bits[0] - bits[1])
            best = int(min(k + abs(m - n + k), (column + np.abs(np.arange(m - 1, -1, -1) - (n - k))).min()))
            if best > most:
                return best
    return score


def _bound(a: str, b: str, most: int) -> int:
    """No less than the distance, if not more than `most`: words that occur once in both lines, in their longest common order, stay; what lies between is compared by itself."""
    places = []
    for text in (a, b):
        seen: dict[str, int] = {}
        at = 0
        for w in text.split(" "):
            seen[w] = -1 if w in seen else at
            at += len(w) + 1
        places.append(seen)
    common = [(x, places[1][w], len(w)) for w, x in places[0].items() if x >= 0 and w and places[1].get(w, -1) >= 0]
    tails: list[int] = []  # the longest ascending chain
    last: list[int] = []
    back = []
    for k, (_, y, _) in enumerate(common):
        at = bisect.bisect_left(tails, y)
        back.append(last[at - 1] if at else -1)
        tails[at : at + 1], last[at : at + 1] = [y], [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(common[k])
        k = back[k]
    total, i, j = 0, 0, 0
    for x, y, n in [*chain[::-1], (len(a), len(b), 0)]:
        p, q = a[i:x], b[j:y]
        total += distance(p, q, max(len(p), len(q))) if len(p) * len(q) <= 250_000 else max(len(p), len(q))
        if total > most:
            break
        i, j = x + n, y + n
    return total


#: Pairs that are compared together.
ABREAST = 32


def distances(pairs: list[tuple[str, str]]) -> list[int]:
    """The Levenshtein distances of many pairs: distance() with the columns of ABREAST pairs side by side in one integer, where an
    operation on all costs little more than on one."""
    out = [max(len(a), len(b)) for a, b in pairs]
    order = sorted((k for k, (a, b) in enumerate(pairs) if a and b), key=lambda k: -out[k])
    for lo in range(0, len(order), ABREAST):
        some = order[lo : lo + ABREAST]
        for k, d in zip(some, _abreast([pairs[k] if len(pairs[k][0]) <= len(pairs[k][1]) else pairs[k][::-1] for k in some])):
            out[k] = d
    return out


def _abreast(pairs: list[tuple[str, str]]) -> list[int]:
    """Of (shorter, longer), none empty, the longest longer ones first. A pair's field has a bit for each character of the shorter one, and one above or more that
    stays empty, where carries end. A row of `equal` tells where the shorter ones have the next characters of the longer ones."""
    width = [len(a) // 8 + 1 for a, _ in pairs]
    begin = np.concatenate([[0], np.cumsum(width)]).tolist()
    rows = np.zeros((len(pairs[0][1]), begin[-1]), np.uint8)
    full = first = 0
    for (a, b), lo, hi in zip(pairs, begin, begin[1:]):
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in (a, b))
        letters = np.unique(x)
        at = np.minimum(np.searchsorted(letters, y), len(letters) - 1)
        table = np.packbits(letters[:, None] == x, axis=1, bitorder="little")
        block = table[at]
        block[letters[at] != y] = 0
        rows[: len(y), lo : lo + table.shape[1]] = block
        full |= ((1 << len(a)) - 1) << 8 * lo
        first |= 1 << 8 * lo
    up, down, out, ended = full, 0, [0] * len(pairs), len(pairs)
    raw, size = rows.tobytes(), begin[-1]
    number = int.from_bytes
    for j in range(len(rows)):
        equal = number(raw[j * size : (j + 1) * size], "little")
        vertical = equal | down
        horizontal = ((((equal & up) + up) ^ up) | vertical) & full
        plus = down | (horizontal | up) ^ full
        plus = plus << 1 & full | first
        up = (up & horizontal) << 1 & full | (vertical | plus) ^ full
        down = plus & vertical
        while ended and len(pairs[ended - 1][1]) == j + 1:  # the column's last entry is its first plus the steps between
            ended -= 1
            at, field = 8 * begin[ended], (1 << len(pairs[ended][0])) - 1
            out[ended] = j + 1 + (up >> at & field).bit_count() - (down >> at & field).bit_count()
    return out


#: Pairs that are compared together by words of 64 rows; fewer than SIDE_BY_SIDE go the other way.
LANES, SIDE_BY_SIDE = 4096, 96
TABLE = 64 << 20  # bytes of the tables of letters' places


def within(pairs: list[tuple[str, str]], most: list[int]) -> list[bool]:
    """Whether the Levenshtein distance of each pair is at most most[k]. Many pairs of like lengths go side by side, in the band of the table that a way of
    so few edits can't leave."""
    out = [max(len(a), len(b)) <= m for (a, b), m in zip(pairs, most)]
    rest = [k for k, (a, b) in enumerate(pairs) if not out[k] and a and b and abs(len(a) - len(b)) <= most[k]]
    lot = [(a, b, most[k]) if len(a) <= len(b) else (b, a, most[k]) for k in rest for a, b in [pairs[k]]]
    order = sorted(range(len(lot)), key=lambda x: (-(len(lot[x][1]) >> 6), len(lot[x][1]) - len(lot[x][0])))
    lo, few = 0, []
    while lo < len(order):
        hi, longest = lo, len(lot[order[lo]][1])
        while hi < len(order) and hi - lo < LANES and len(lot[order[hi]][1]) >= 0.75 * longest - 64:
            hi += 1
        some = sorted(order[lo:hi], key=lambda x: -len(lot[x][1]))
        lo = hi
        found = _in_band([lot[x] for x in some]) if len(some) >= SIDE_BY_SIDE else None
        if found is None:
            few += some
        for x, ok in zip(some, found or []):
            out[rest[x]] = ok
    for x, d in zip(few, distances([lot[x][:2] for x in few])):
        out[rest[x]] = d <= lot[x][2]
    return out


def _in_band(lot: list[tuple[str, str, int]]) -> list[bool] | None:
    """Of (shorter, longer, most), the longest longer ones first: the columns of the table in words of 64 rows (Myers 1999, Hyyrö 2003), all pairs' at once. Words come and
    go as the band does, every 64 columns; above the band a column's entries are taken to be one more than the last column's, below it one more than the row above,
    which is never too little. Then pairs that can't end within `most` go, too. None where the tables of many letters would be large."""
    n = len(lot)
    size, most = np.array([len(b) for _, b, _ in lot]), np.array([m for *_, m in lot])
    short = np.array([len(a) for a, *_ in lot])
    low = int(((most - size + short) // 2).max())
    up = int((size - short + (most - size + short) // 2).max())

    number: dict[str, int] = {}
    first = np.array([number.setdefault(a, len(number)) for a, *_ in lot])
    second = np.array([number.setdefault(b, len(number)) for _, b, _ in lot])
    length = np.array([len(t) for t in number])
    text = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
    code = np.frombuffer("".join(number).encode("utf-32-le", "surrogatepass"), "<u4")
    used = np.zeros(0x110000, bool)
    used[code] = True
    wide = int(used.sum())
    if len(length) * wide * (int(size[0]) // 64 + 4) * 8 > TABLE:
        return None
    code = (np.cumsum(used, dtype=np.int32) - 1)[code]
    letter = np.zeros((len(length), int(size[0]) + 64), np.int32)
    letter[np.arange(letter.shape[1]) < length[:, None]] = code
    table = np.zeros(((int(size[0]) + low) // 64 + 2, len(length) * wide), U)  # where a letter is in a text
    np.add.at(table.reshape(-1), (place >> 6) * table.shape[1] + text * wide + code, U(1) << (place & 63).astype(U))
    full, one, last = ~U(0), U(1), U(63)
    ok = np.zeros(n, bool)
    lane, above = np.arange(n), np.zeros(n, np.int64)  # what a column's entry above the band has, besides its number
    top, plus, minus = 0, [], []
    for start in range(0, int(size[0]), 64):
        begin, end = max(0, (start - up) // 64), (start + 63 + low) // 64 + 1
        for _ in range(top, begin):
            above += np.bitwise_count(plus.pop(0)).astype(np.int64) - np.bitwise_count(minus.pop(0))
        top = begin
        while len(plus) < end - top:
            plus.append(np.full(len(lane), full))
            minus.append(np.zeros(len(lane), U))
        where = np.ascontiguousarray((letter[:, start : start + 64][second[lane]] + (first[lane] * wide)[:, None]).T)
        left = size[lane] - start  # descending
        ends = set(left[left <= 64].tolist())
        for j in range(1, min(64, int(left[0])) + 1):
            more, less = one, None  # the steps of the row above
            at = where[j - 1]
            for w in range(len(plus)):
                equal, p, m = table[top + w].take(at), plus[w], minus[w]
                vertical = equal | m
                if less is not None:
                    equal |= less
                horizontal = equal & p
                horizontal += p
                horizontal ^= p
                horizontal |= equal
                x = horizontal | p
                np.invert(x, out=x)
                x |= m
                horizontal &= p
                carry, borrow = x >> last, horizontal >> last
                x <<= one
                x |= more
                horizontal <<= one
                if less is not None:
                    horizontal |= less
                np.bitwise_and(x, vertical, out=m)
                x |= vertical
                np.invert(x, out=x)
                np.bitwise_or(x, horizontal, out=p)
                more, less = carry, borrow
            if j in ends:
                done = np.flatnonzero(left == j)
                total = start + j + above[done]
                for w in range(len(plus)):
                    rows = np.clip(short[lane[done]] - 64 * (top + w), 0, 64)
                    mask = np.where(rows > 0, full >> (64 - np.maximum(rows, 1)).astype(U), U(0))
                    total += np.bitwise_count(plus[w][done] & mask).astype(np.int64) - np.bitwise_count(minus[w][done] & mask)
                ok[lane[done]] = total <= most[lane[done]]
        # every eighth entry of the column, less what those between may have less, and the least way to the end
        steps = [np.bitwise_count(p.view(np.uint8)).astype(np.int16) - np.bitwise_count(m.view(np.uint8)).astype(np.int16) for p, m in zip(plus, minus)]
        column = np.cumsum(np.concatenate([np.zeros((len(lane), 1), np.int64), *(s.reshape(-1, 8) for s in steps)], axis=1), axis=1) + (above + start + 64)[:, None]
        away = np.abs((short[lane] - size[lane] + start + 64)[:, None] - np.arange(64 * top, 64 * (top + len(plus)) + 1, 8))
        on = np.flatnonzero((left > 64) & ((column + away).min(1) - 8 <= most[lane]))
        if not len(on):
            break
        if len(on) < 0.9 * len(lane) or int(left[on[-1]]) > 64 >= int(left[-1]):
            lane, above = lane[on], above[on]
            plus, minus = [p[on] for p in plus], [m[on] for m in minus]
    return ok.tolist()


def edit_similar(pairs: list[tuple[str, str]], least: float) -> list[bool]:
    """Whether the edit similarity of each pair is `least` or more."""
    out = [False] * len(pairs)
    rest: list[tuple[int, int, str, str]] = []
    for k, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        most = int(longer * (1 - least) + 1e-9)
        if longer - min(len(a), len(b)) > most:
            continue
        if a[:1] == b[:1] or a[-1:] == b[-1:]:
            a, b = _stripped(a, b)
        if max(len(a), len(b)) <= most:
            out[k] = True
            continue
        if a.count(" ") == b.count(" ") and sum(max(len(p), len(q)) for p, q in zip(a.split(" "), b.split(" ")) if p != q) <= most:  # words for words
            out[k] = True
        elif longer > 2000:  # the whole table would be large
            out[k] = _bound(a, b, most) <= most or distance(a, b, most) <= most
        else:
            rest.append((k, most, a, b))
    if len(rest) < 8:
        for k, most, a, b in rest:
            out[k] = distance(a, b, most) <= most
    else:
        for (k, *_), ok in zip(rest, within([r[2:] for r in rest], [r[1] for r in rest])):
            out[k] = ok
    return out


def _links(least: float):
    """Verified links of cells of (form): edit similarity of `least`, of pairs whose lengths and signatures promise it."""

    def found(rows: pa.RecordBatch, cuts: list[int], parts: list | None) -> Iterator[tuple[int, int]]:
        enter("lines")
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        texts = rows.column("form").to_pylist()
        sides = rows.column("side").to_numpy() if "side" in rows.schema.names else None
        square, cross = lambda lo, hi: promises_of_all(signature[lo:hi], least, enough=PROMISE), lambda lo, at, hi: promises_of_all(signature[lo:at], least, signature[at:hi], PROMISE)
        return links.spanning(cuts, lambda i, j: promise(signature[i], signature[j], least, PROMISE), square, PROMISE, lambda pairs: edit_similar([(texts[i], texts[j]) for i, j in pairs], least), parts, sides, cross)

    return found


def removals(docs: DataFrame, least: float = 0.8, min_chars: int = 1, cell: int = 1024) -> DataFrame:
    """(_k1, _k2, lines): the line numbers to cut from each document that has any. docs: doc_id, _k1, _k2, text."""
    ranges = RANGES * tasks(docs.sparkSession)
    blobs = stash(merged(spread(docs.select("doc_id", "_k1", "_k2", "text"), min_chars, ranges), ranges, least), "lines")
    gone = _rows(blobs, CUTS, CUT)
    crowd = _rows(blobs, CROWD, MET).select(F.col("run").alias("bucket"), "key")
    cells = stash(_rows(blobs, CELLS, MET).union(links.salted(crowd)).distinct(), "cells")
    if not cells.isEmpty():
        known = stash(contents(docs, cells.select("key").distinct(), min_chars), "contents")
        near = links.promises(cells.join(known.select("key", "signature"), "key"), "u1", lambda a, b: promise(a, b, least, PROMISE) >= PROMISE)
        promised = links.components(near)
        labels = links.verified(promised, known, _links(least), [F.col("form"), F.reverse("form")], cell)
        folder = keyset.write(labels.select(F.col("node").alias("key")))

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = keyset.KeySet(folder)
            for b in batches:
                for raw in b.column("records").to_pylist():
                    r = np.frombuffer(raw, OCCURRENCE)
                    r = r[wanted.contains(r["key"])]
                    if len(r):
                        doc = pa.array(r["doc"].copy(), mask=r["none"].astype(bool))
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r["key"]).view(np.int64)), doc, *(pa.array(r[c].copy()) for c in ("k1", "k2", "line"))], ["key", "doc_id", "_k1", "_k2", "line"])

        first = blobs.where(F.col("kind") == ITEMS).select("records").mapInArrow(linked, "key long, doc_id long, _k1 long, _k2 long, line int")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2", "line")
        first = stash(first.join(labels.withColumnRenamed("node", "key"), "key").select("root", place.alias("place")), "places")
        kept = first.groupBy("root").agg(F.min("place").alias("kept"))
        gone = gone.unionByName(first.join(kept, "root").where("place != kept").select("place._k1", "place._k2", "place.line"))
    return gone.groupBy("_k1", "_k2").agg(F.collect_set("line").alias("lines"))


def _cleaned(docs: DataFrame, **how) -> tuple[DataFrame, list[str]]:
    """keyed() docs with `left`, the text without the lines to cut, and the counts."""
    plain, names = keyed(docs, doc_id="long", text="string")
    cut = removals(plain, **how).withColumnRenamed("lines", "cut")
    plain, text = plain.drop("doc_id", "text"), F.col(f"c{names.index('text')}").cast("string")  # the text is exchanged once
    lines = F.split(text, "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("cut", i)), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    return plain.join(cut, ["_k1", "_k2"], "left").withColumns({"left": F.when(F.col("cut").isNull(), text).otherwise(left), "n_lines": n_lines, "n_removed": F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).cast("long")}), names


def cleaned(docs: DataFrame, **how) -> DataFrame:
    """docs, every row, with text without the lines to cut, and n_lines, n_removed (which replace columns of these names)."""
    found, names = _cleaned(docs, **how)
    kept = [F.col("left" if name == "text" else f"c{k}").alias(name) for k, name in enumerate(names) if name not in ("n_lines", "n_removed")]
    return found.select(*kept, "n_lines", "n_removed")


def dedup(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs; n_chars, where there is one, follows the text; documents of which no word is left go."""
    found, names = _cleaned(docs, **how)
    gone = (F.col("n_removed") > 0) & ~F.coalesce("left", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    instead: dict[str, Column] = {"text": F.col("left")}
    if "n_chars" in names:
        instead["n_chars"] = F.length("left").cast(docs.schema[names.index("n_chars")].dataType)
    return named(found.where(~gone), names, **instead)
