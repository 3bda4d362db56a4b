"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, mapped by workers.

Tokens: words of the text (A-Z lowered) and one end token for each text. Three steps over the corpus:

1. unigrams: 64-bit word hashes, counted in each task's steps, are merged by hash range and written as sorted
   arrays; a token's id is its rank among all of them;
2. bigrams: pairs of ids (a text begins with its own context id) are counted in each task and merged by the range
   of a bijective mix of the pair, which spreads the pairs of a frequent word over all ranges; the sorted mixed
   pairs with their counts are the model's top order. From each range, sums by context (count, types with count 1,
   2, 3 or more) and by word (types before it) go, summed up beforehand, to ranges of ids: dense arrays;
3. scoring: workers map the arrays (numpy memmap, shared between the processes of a machine) and look up each
   step's distinct pairs in sorted order.

    p(w | v) = max(0, c(v w) - D(c)) / c(v .) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) / c(v .) * p(w)
    p(w)     = max(0, n(. w) - D'(n)) / n(. .) + (D1' m1 + D2' m2 + D3' m3) / n(. .) / (V + 1)

with D from the counts of counts of each order (Chen and Goodman 1998), and an unseen context giving p(w). An unseen word has the last
term alone, so the probabilities of V words and one unknown sum to 1. Only the number of ranges, a few sums and
the files' names pass the driver. Files are written under another name and renamed: repeated tasks are safe.

Nulls and empty texts: the end token alone. Repeated rows count for themselves. Without training documents
every word is unknown: p = 1 / (V + 1) with V = 0.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcintel.llm.shared import fresh, ship
from srcintel.llm.text import U, enter, mix, per_text, steps, unmix, words

END = U(0x5EED0E4D0F7E87)
#: Ids that a half of a pair holds; a larger vocabulary is an error, not a wrong model.
MOST_TYPES = 1 << 32
#: Ids in a file of dense arrays.
DENSE = 1 << 20


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text closed with END, and each text's offset."""
    w = words(col, lower=True)
    return np.insert(w.hash, w.ptr[1:], END), w.ptr + np.arange(len(w.ptr))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _pack(counts: np.ndarray) -> bytes:
    """Counts as bytes, 255 for those that follow as 64 bits."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype("<u8").tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


def _emit(keys: np.ndarray, counts: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys and counts cut by range of the key."""
    cut = np.searchsorted(keys, np.array([((r << 64) // ranges) for r in range(1, ranges)], U)) if ranges > 1 else np.zeros(0, np.int64)
    bound = [0, *cut.tolist(), len(keys)]
    rows = [(r, keys[a:b].astype("<u8").tobytes(), _pack(counts[a:b])) for r, (a, b) in enumerate(zip(bound, bound[1:])) if b > a]
    if rows:
        r, k, c = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], ["part", "keys", "counts"])


class _Counter:
    """Counts keys in bounded memory: merges what came when `limit` keys have gathered, and emits when merging no longer helps."""

    def __init__(self, ranges: int, limit: int):
        self.ranges, self.limit = ranges, limit
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.limit:
            keys, counts = merged(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.held = [keys], [counts], len(keys)
            if self.held > self.limit // 2:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from _emit(*merged(np.concatenate(self.keys), np.concatenate(self.counts)), self.ranges)
        self.keys, self.counts, self.held = [], [], 0


def _save(to: str, **arrays: np.ndarray) -> None:
    for name, a in arrays.items():
        part = f"{to}.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, a)
        os.replace(part, f"{to}.{name}.npy")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, keys, counts) merged, from rows sorted by part."""
    part, keys, counts, held = None, [], [], 0
    for batch in batches:
        for p, k, c in zip(*(batch.column(n).to_pylist() for n in ("part", "keys", "counts"))):
            if part is not None and p != part:
                yield part, *merged(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [], [], 0
            part = p
            keys.append(np.frombuffer(k, "<u8"))
            counts.append(_unpack(c, len(keys[-1])))
            held += len(keys[-1])
            if held > 6_000_000 and len(keys) > 1:
                k2, c2 = merged(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [k2], [c2], len(k2) // 2
    if part is not None:
        yield part, *merged(np.concatenate(keys), np.concatenate(counts))


PARTS = "part int, keys binary, counts binary"


@dataclass
class Model:
    folder: str
    ranges: int
    unigram_ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # ids before each range, and V
    total: int = 0  # training tokens
    discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))  # of counts 1, 2, 3 and more in bigrams, index 1..3
    low_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    types: int = 0  # distinct bigrams
    low_left: float = 1.0  # what the lower order leaves to the uniform distribution

    @property
    def v(self) -> int:
        return int(self.unigram_ends[-1])


def _open(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


class Reader:
    """Look-ups in a model's files."""

    def __init__(self, m: Model):
        self.m = m
        self.maps: dict[str, np.ndarray] = {}

    def map(self, name: str) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = _open(f"{self.m.folder}/{name}.npy")
        return self.maps[name]

    def _ranged(self, keys: np.ndarray, name: str) -> Iterator[tuple[int, slice]]:
        cut = np.searchsorted(keys, np.array([((r << 64) // self.m.ranges) for r in range(1, self.m.ranges)], U)) if self.m.ranges > 1 else np.zeros(0, np.int64)
        bound = [0, *cut.tolist(), len(keys)]
        for r, (a, b) in enumerate(zip(bound, bound[1:])):
            if b > a:
                yield r, slice(a, b)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each of the ascending hashes; V and 0 for unknown ones."""
        out, n = np.full(len(hashes), self.m.v, np.int64), np.zeros(len(hashes), np.int64)
        for r, s in self._ranged(hashes, "uni"):
            if self.m.unigram_ends[r + 1] == self.m.unigram_ends[r]:
                continue
            known = self.map(f"uni-{r}.keys")
            at = np.minimum(np.searchsorted(known, hashes[s]), len(known) - 1)
            hit = known[at] == hashes[s]
            out[s] = np.where(hit, at + self.m.unigram_ends[r], self.m.v)
            n[s] = np.where(hit, self.map(f"uni-{r}.counts")[at], 0)
        return out, n

    def bigrams(self, mixed: np.ndarray) -> np.ndarray:
        """Counts of the ascending mixed pairs."""
        n = np.zeros(len(mixed), np.int64)
        for r, s in self._ranged(mixed, "bi"):
            if not os.path.exists(f"{self.m.folder}/bi-{r}.keys.npy"):
                continue
            known = self.map(f"bi-{r}.keys")
            at = np.minimum(np.searchsorted(known, mixed[s]), len(known) - 1)
            n[s] = np.where(known[at] == mixed[s], self.map(f"bi-{r}.counts")[at], 0)
        return n

    def dense(self, ids: np.ndarray, name: str) -> np.ndarray:
        """Rows of dense arrays for ascending ids (zeros where there are none)."""
        out = None
        bound = np.searchsorted(ids, np.arange(0, (int(ids[-1]) // DENSE + 2) * DENSE if len(ids) else DENSE, DENSE)).tolist()
        for r, (a, b) in enumerate(zip(bound, bound[1:])):
            path = f"{self.m.folder}/{name}-{r}.rows.npy"
            if b > a and os.path.exists(path):
                rows = self.map(f"{name}-{r}.rows")
                if out is None:
                    out = np.zeros((len(ids), rows.shape[1]), np.int64)
                out[a:b] = rows[ids[a:b] - r * DENSE]
        return np.zeros((len(ids), 4), np.int64) if out is None else out


def _text_ids(reader: Reader, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id of each token, id of its context, count of each token, offsets)."""
    hashes, ptr = tokens(col)
    distinct, which = np.unique(hashes, return_inverse=True)
    ids, counts = reader.ids(distinct)
    token = ids[which]
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[ptr[:-1]] = reader.m.v + 1  # the beginning of a text
    return token, context, counts[which], ptr


def discounts(n: np.ndarray) -> np.ndarray:
    """Chen and Goodman's three discounts (index 1..3) from the counts of counts n[1..4]; zero classes, and estimates that aren't positive, fall back to absolute discounting."""
    out = np.zeros(4)
    if n[1] == 0:
        return out
    y = n[1] / (n[1] + 2 * n[2])
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else y
        out[k] = min(d, k) if d > 0 else y
    return out


def _positive(d: np.ndarray) -> np.ndarray:
    """Without counts of 1 there is no estimate: half of one is taken, so that what wasn't seen has a probability."""
    return d if d[1] else np.array([0, 0.5, 0.5, 0.5])


def _spread(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "part").sortWithinPartitions("part")


def train(docs: DataFrame, folder: str, ranges: int = 0) -> Model:
    spark = docs.sparkSession
    ship(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = ranges or 4 * parts
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def count_unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("kneser_ney")
        counter = _Counter(ranges, 2_000_000)
        for batch in steps(batches):
            keys, n = np.unique(tokens(batch.column("text"))[0], return_counts=True)
            yield from counter.add(keys, n)
        yield from counter.out()

    def save_unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _gathered(batches):
            _save(f"{folder}/uni-{part}", keys=keys, counts=counts)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "types": [len(keys)], "total": [int(counts.sum())]})

    rows = _spread(texts.mapInArrow(count_unigrams, PARTS), parts).mapInArrow(save_unigrams, "part int, types long, total long").collect()  # a row for each range
    ends = np.zeros(ranges + 1, np.int64)
    for r in rows:
        ends[r["part"] + 1] = r["types"]
    m = Model(folder, ranges, np.cumsum(ends), sum(r["total"] for r in rows))
    if not m.total:
        return m
    if m.v + 2 > MOST_TYPES:
        raise ValueError(f"{m.v} distinct tokens: ids of 32 bits tell {MOST_TYPES - 2} apart")

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("kneser_ney")
        reader, counter = Reader(m), _Counter(ranges, 6_000_000)
        for batch in steps(batches):
            token, context, _, _ = _text_ids(reader, batch.column("text"))
            keys = mix((context.astype(U) << U(32)) | token.astype(U))
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            yield from counter.add(keys[first], np.diff(np.append(first, len(keys))))
        yield from counter.out()

    kinds = 4

    def save_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the ranges; emits sums by context and by word: part = 2 * (id // DENSE) + (0 context, 1 word)."""
        for part, keys, counts in _gathered(batches):
            _save(f"{folder}/bi-{part}", keys=keys, counts=counts.astype(np.uint32) if counts.max() < 1 << 32 else counts)
            pair = unmix(keys)
            by_count = np.bincount(np.minimum(counts, 5), minlength=6)
            yield _sums(-1, np.arange(5), by_count[:5].astype(np.int64)[:, None])
            for side, ids in enumerate(((pair >> U(32)).astype(np.int64), (pair & U(0xFFFFFFFF)).astype(np.int64))):
                order = np.argsort(ids, kind="stable")
                ids, c = ids[order], counts[order]
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                if side == 0:
                    table = np.stack([c, c == 1, c == 2, c >= 3], 1).astype(np.int64)
                    sums = np.add.reduceat(table, first, axis=0)
                else:
                    sums = np.diff(np.append(first, len(ids)))[:, None]
                ids = ids[first]
                bound = np.searchsorted(ids, np.arange(0, int(ids[-1]) + 2 * DENSE, DENSE)).tolist()
                for r, (a, b) in enumerate(zip(bound, bound[1:])):
                    if b > a:
                        yield _sums(2 * r + side, ids[a:b], sums[a:b])

    def _sums(part: int, ids: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        wide = b"".join(_pack(sums[:, k]) for k in range(sums.shape[1]))
        sizes = np.array([len(_pack(sums[:, k])) for k in range(sums.shape[1])], "<u4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ids.astype("<u4").tobytes()], pa.binary()), pa.array([sizes + wide], pa.binary())], ["part", "keys", "counts"])

    def _read_sums(keys: bytes, raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(keys, "<u4").astype(np.int64)
        sizes = np.frombuffer(raw, "<u4", width).tolist()
        at, cols = 4 * width, []
        for s in sizes:
            cols.append(_unpack(raw[at : at + s], len(ids)))
            at += s
        return ids, np.stack(cols, 1)

    def save_dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Dense arrays; emits counts of counts: order 2 (part -1) and order 1 (from the words' types)."""
        held, table = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if held is None:
                return
            if held >= 0:
                _save(f"{folder}/{('context', 'word')[held % 2]}-{held // 2}", rows=table)
            if held < 0 or held % 2:
                n = table[:5, 0] if held < 0 else np.bincount(np.minimum(table[:, 0], 5), minlength=6)[:5]
                more = int((table[:, 0] >= 3).sum()) if held >= 0 else 0
                yield pa.RecordBatch.from_pydict({"order": pa.array([2 if held < 0 else 1], pa.int32()), "n": pa.array([n.tolist()], pa.list_(pa.int64())), "types": [int(table[:, 0].sum()) if held >= 0 else 0], "more": [more]})

        for batch in batches:
            for part, keys, raw in zip(*(batch.column(n).to_pylist() for n in ("part", "keys", "counts"))):
                if part != held:
                    yield from done()
                    held, table = part, np.zeros((5 if part < 0 else DENSE, kinds if part >= 0 and part % 2 == 0 else 1), np.int64)
                ids, sums = _read_sums(keys, raw, table.shape[1])
                table[ids if part < 0 else ids % DENSE] += sums
        yield from done()

    pairs = _spread(texts.mapInArrow(count_bigrams, PARTS), parts).mapInArrow(save_bigrams, PARTS)
    rows = _spread(pairs, parts).mapInArrow(save_dense, "order int, n array<long>, types long, more long").collect()  # a row for each DENSE ids
    n2, n1 = (np.sum([r["n"] for r in rows if r["order"] == k] or [[0] * 5], axis=0) for k in (2, 1))
    m.types = sum(r["types"] for r in rows)
    m.discounts, m.low_discounts = _positive(discounts(n2)), _positive(discounts(n1))
    more = sum(r["more"] for r in rows)
    m.low_left = float(m.low_discounts[1] * n1[1] + m.low_discounts[2] * n1[2] + m.low_discounts[3] * more) / max(1, m.types)
    return m


def log_probabilities(reader: Reader, token: np.ndarray, context: np.ndarray) -> np.ndarray:
    """log10 p(token | context) of each pair of ids."""
    m = reader.m
    pair = (context.astype(U) << U(32)) | token.astype(U)
    mixed, which = np.unique(mix(pair), return_inverse=True)
    pair = unmix(mixed)
    v, w = (pair >> U(32)).astype(np.int64), (pair & U(0xFFFFFFFF)).astype(np.int64)
    count = reader.bigrams(mixed)
    ids, at = np.unique(w, return_inverse=True)
    types = reader.dense(ids, "word")[:, 0][at]
    ids, at = np.unique(v, return_inverse=True)
    own = reader.dense(ids, "context")
    own = own[:, :4][at] if own.shape[1] >= 4 else np.zeros((len(at), 4), np.int64)
    low = np.maximum(0, types - m.low_discounts[np.minimum(types, 3)]) / max(1, m.types) + m.low_left / (m.v + 1)
    seen = own[:, 0] > 0
    base = np.maximum(1, own[:, 0])
    left = (own[:, 1:] @ m.discounts[1:]) / base
    high = np.maximum(0, count - m.discounts[np.minimum(count, 3)]) / base
    p = np.where(seen, high + left * low, low)
    return np.log10(p)[which]


def score(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of each document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(m)  # names, range ends, discounts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("kneser_ney")
        m = shared.value
        reader = Reader(m)
        for batch in steps(batches, limit=4 << 20):
            token, context, count, ptr = _text_ids(reader, batch.column("text"))
            base = np.log10((count + 0.1) / (m.total + 0.1 * (m.v + 1)))
            log = log_probabilities(reader, token, context)
            size, got = np.diff(ptr), per_text(log, ptr)
            arrays = [size, per_text((count > 0).astype(np.int64), ptr), np.full(batch.num_rows, m.total), per_text(base, ptr), got, 10 ** np.minimum(300, -got / size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, arrays)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def train_and_score(docs: DataFrame, training: DataFrame) -> DataFrame:
    return score(docs, train(training, fresh(docs.sparkSession, "kneser-ney")))
