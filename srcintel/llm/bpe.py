"""Encoding with a tokenizers file by cached pieces, equal to encoding the whole text.

The normaliser and splitter that are known here never join characters across ASCII white space, so the ids of a text are
those of its white-space-separated chunks in order. A chunk of printable ASCII and Latin-1 letters is split into pieces by the
splitter's rules over whole arrays of bytes; every other chunk (other scripts, control characters, special tokens) is one
unit that goes through the library, or several where a full stop of East Asian scripts precedes a letter. Each distinct unit is encoded once; a bounded table keeps units between the steps of a
worker. With a file whose normaliser or splitter is another one, the library encodes the texts whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from srcintel.llm.text import LOWER, SPACE, U, as_bytes, at_change, range_hash, runs, steps


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Units that a worker remembers; beyond it the table starts anew.
CACHE = 600_000
#: Bytes of text that are encoded at once, whose arrays take many times as much; a longer single text is a part of its own.
PART = 1 << 20
#: Bytes of a unit up to which the rolling hash stands for it; longer ones are hashed one by one.
LONG = 64

#: What this module does itself; a file with another normaliser or splitter is left to the library.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LETTER, DIGIT, OTHER = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = OTHER
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_AFTER_C3 = np.zeros(256, bool)  # second bytes of Latin-1 letters
_AFTER_C3[0x80:0xC0] = True
_AFTER_C3[[0x97, 0xB7]] = False


#: What ends a sentence, and what may follow it inside the same unit.
STOPS = ".!?\u2026\u203c\u2047\u2048\u2049\u3002\uff61\uff01\uff1f\uff0e\u061f\u06d4\u0964\u0965\u1362\u17d4\u104b"
CLOSERS = "\"')]}\u00bb\u201d\u2019\u300d\u300f\uff09\u3011"
_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".!?"]] = 1


def _shown() -> np.ndarray:
    """The printable character that byte-level models use for each byte; the blank stays, as it parts pieces here."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out = np.zeros(256, "<u4")
    out[sorted(kept)] = sorted(kept)
    rest = [b for b in range(256) if b not in kept]
    out[rest] = 256 + np.arange(len(rest))
    out[32] = 32
    return out


_SHOWN = _shown()


class Table:
    """64-bit keys to numbers 0, 1, 2 ... in the order in which they were put in: an open hash table over arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, U)
        self.values = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        mask = len(self.keys) - 1
        at = (keys >> U(64 - self.bits)).astype(np.int64)
        out = self.values[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(left):
            at[left] = (at[left] + 1) & mask
            got = self.values[at[left]]
            out[left] = got
            left = left[(got >= 0) & (self.keys[at[left]] != keys[left])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """keys: distinct and not yet in it."""
        while 2 * (self.n + len(keys)) > len(self.keys):
            held, order = self.keys[self.values >= 0], self.values[self.values >= 0]
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int32)
            self._place(held, order)
        self._place(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = (keys >> U(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.values[at[left]] < 0]
            self.values[at[free]] = values[free]  # of several for one place, the last stays
            self.keys[at[free]] = keys[free]
            left = left[self.values[at[left]] != values[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(form, starts, ends, plain, ptr): the text's bytes with plain chunks in lower case; each unit's range in them and whether it is
    a piece of a plain chunk; each text's range of units."""
    n = len(data)
    kind = np.zeros(n + 3, np.uint8)  # a margin, so that what follows can be asked for
    kind[:n] = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_AFTER_C3[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = LETTER
    first, last, ptr = runs(~SPACE[data], off)
    form = np.zeros(n + 3, np.uint8)
    form[:n] = LOWER[data]
    capital = lead[data[lead + 1] <= 0x9E] + 1
    form[capital] += 0x20
    odd = (kind[:n] == 0) & ~SPACE[data]
    special = np.flatnonzero(data[:-1] == 60)
    odd[special[data[special + 1] == 124]] = True  # <| may begin a special token
    begins = np.zeros(n + 3, bool)
    edge = np.empty(n + 3, bool)
    edge[0] = True
    edge[1:] = kind[1:] != kind[:-1]
    edge |= kind == DIGIT
    edge[:n] &= ~SPACE[data]
    edge[n:] = False
    begins[first] = True
    edge[first] = True
    odd_at = np.flatnonzero(odd)
    strange = np.unique(np.searchsorted(first, odd_at, "right") - 1) if len(odd_at) else odd_at
    inside = np.zeros(n, bool)
    if len(strange):
        change = np.zeros(n + 1, np.int8)
        change[first[strange]] = 1
        change[last[strange]] -= 1
        inside = np.cumsum(change[:n], dtype=np.int8).astype(bool)
        edge[:n] &= ~inside
        edge[first] = True
        # a full stop, exclamation or question mark of East Asian width before a Han, Hiragana or Hangul letter: no rule joins them
        wide = np.flatnonzero((data[:-4] == 0xE3) & (data[1:-3] == 0x80) & (data[2:-2] == 0x82) | (data[:-4] == 0xEF) & (data[1:-3] == 0xBC) & ((data[2:-2] == 0x81) | (data[2:-2] == 0x9F)))
        after, second = data[wide + 3], data[wide + 4]
        edge[wide[((after >= 0xE5) & (after <= 0xE9) | (after == 0xEB) | (after == 0xEC) | (after == 0xE4) & (second >= 0xB8) | (after == 0xE3) & (second == 0x81)) & inside[wide + 3]] + 3] = True
        form[:n][inside] = data[inside]
        kind[:n][inside] = 0  # no contractions there
    quote = np.flatnonzero(form[:n] == 39)
    quote = quote[edge[quote] & (kind[quote] == OTHER) & ~begins[quote + 1]]
    a, b = form[quote + 1], form[quote + 2]
    short = (a == 115) | (a == 116) | (a == 109) | (a == 100)
    long = ((b == 101) & ((a == 114) | (a == 118)) | (a == 108) & (b == 108)) & ~begins[quote + 2]
    hit = (short | long) & (kind[quote + 1] == LETTER)
    edge[quote[hit] + 1] = False
    after = quote[hit] + np.where(short, 2, 3)[hit]
    edge[after] |= kind[after] != 0
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    own = np.searchsorted(start, first)
    end[np.append(own[1:], len(start))[: len(own)] - 1] = last
    return form[:n], start, end, ~inside[start], np.searchsorted(start, off)


class ChunkEncoder:
    _of: dict[str, "ChunkEncoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = Tokenizer(self.model)
        self.split.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.known = file.get("normalizer") == NORMALIZER and file.get("pre_tokenizer") == SPLITTER and not file.get("post_processor") and file["model"].get("end_of_word_suffix") == "</w>"
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.table = Table()
        self.ids = np.zeros(0, np.uint32)  # of all units in the table, one after another
        self.first = np.zeros(1, np.int64)
        self.stops = np.zeros(0, bool)  # units that end a sentence

    @classmethod
    def at(cls, path: str) -> "ChunkEncoder":
        """One for each worker process and file."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _pieces(self, form: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each has) of pieces of plain chunks: encoded together, split only at blanks, and cut where a token ends a word."""
        stop = np.cumsum(size + 1)
        buffer = np.full(int(stop[-1]), 32, np.uint8)
        at = np.repeat(stop - size - 1, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
        buffer[at] = form[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        text = _SHOWN[buffer].tobytes().decode("utf-32-le")
        ids = np.array(self.split.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(start):
            return ids, np.diff(np.append(0, cuts))
        each = [[t.id for t in self.model.tokenize(p)] for p in text.split(" ")[: len(start)]]  # a piece that the vocabulary can't spell
        return np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def _learn(self, keys: np.ndarray, form: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> None:
        ids, sizes, order = [], [], []
        marks = np.concatenate([[0], np.cumsum(_STOP[form])])
        stops = plain & (marks[end] > marks[start])
        at = np.flatnonzero(plain)
        for lo in range(0, len(at), 4000):
            some = at[lo : lo + 4000]
            a, b = self._pieces(form, start[some], end[some] - start[some])
            ids.append(a)
            sizes.append(b)
        order.append(at)
        at = np.flatnonzero(~plain)
        for lo in range(0, len(at), 2000):
            raw = [form[s:e].tobytes().decode() for s, e in zip(start[at[lo : lo + 2000]].tolist(), end[at[lo : lo + 2000]].tolist())]
            stops[at[lo : lo + 2000]] = [t.rstrip(CLOSERS)[-1:] in STOPS and t.rstrip(CLOSERS) != "" for t in raw]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(raw, add_special_tokens=False)]
            ids.append(np.array([x for e in found for x in e], np.uint32))
            sizes.append(np.array([len(e) for e in found], np.int64))
        order.append(at)
        self.table.add(keys[np.concatenate(order)])
        self.ids = np.concatenate([self.ids, *ids])
        self.stops = np.concatenate([self.stops, stops[np.concatenate(order)]])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.concatenate(sizes)))

    def _whole(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pc.fill_null(col, "").to_pylist(), add_special_tokens=False)]
        return np.array([x for e in found for x in e], np.uint32), np.cumsum([0, *map(len, found)])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) one after another, and each text's offset in them."""
        return self.encode_marked(col)[:2]

    def encode_marked(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and where sentences end: numbers of ids, ascending. With a tokenizer that the library encodes whole there are none."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        none = np.zeros(0, np.int64)
        ids, ptrs, ends, seen = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], [none], 0
        for part in steps(iter([pa.RecordBatch.from_arrays([col], ["text"])]), limit=PART):
            own, ptr, stops = self._part(part.column("text"))
            ids.append(own)
            ptrs.append(ptr[1:] + seen)
            ends.append(stops + seen)
            seen += len(own)
        at = np.concatenate(ends)
        return np.concatenate(ids), np.concatenate(ptrs), at[np.append(True, at[1:] != at[:-1])] if len(at) else at

    def _part(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encode_marked of so many texts as go at once; a sentence's end may be there twice."""
        if not self.known:
            return *self._whole(col), np.zeros(0, np.int64)
        data, off = as_bytes(col)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64), np.zeros(0, np.int64)
        form, start, end, plain, ptr = units(data, off)
        key = range_hash(form, start, end)
        for k in np.flatnonzero(end - start > LONG).tolist():
            key[k] = xxhash.xxh64_intdigest(form[start[k] : end[k]].tobytes())
        if self.table.n > CACHE:
            self.forget()
        which = self.table.find(key)
        new = np.flatnonzero(which < 0)
        if len(new):
            distinct, one = np.unique(key[new], return_index=True)
            one = new[one]
            self._learn(distinct, form, start[one], end[one], plain[one])
            which[new] = self.table.find(key[new])
        each = np.diff(self.first)[which]
        at = np.zeros(len(which) + 1, np.int64)
        np.cumsum(each, out=at[1:])
        ids = self.ids[np.repeat(self.first[which] - at[:-1], each) + np.arange(at[-1])]
        return ids, at[ptr], at[1:][self.stops[which]]

    def encode_closed(self, col: pa.Array, end: int, marked: bool = False) -> tuple[np.ndarray, ...]:
        """ids and offsets with the id `end` after each text; marked: and where sentences end."""
        ids, ptr, stops = self.encode_marked(col)
        at = ptr[1:]
        out = np.insert(ids, at, np.uint32(end)), ptr + np.arange(len(ptr))
        # a sentence that ends with its text ends before the end id, where no cut is wanted: the document's own end follows
        return (*out, (stops + np.searchsorted(at, stops))[~np.isin(stops, at)]) if marked else out


@at_change
def forget() -> None:
    """Drops what the encoders of this process remember."""
    for e in ChunkEncoder._of.values():
        e.forget()
