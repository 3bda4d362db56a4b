"""Near-duplicate documents by ProbMinHash over weighted shingles, banding, and exact verification.

A document is its words (A-Z lowered); its shingles are the runs of `width` words (all words, if fewer), each
weighted by how often it occurs. ProbMinHash: each shingle d of weight w is a Poisson process of rate w whose
arrivals, seeded by the shingle's hash, fall into random registers; a register keeps the shingle that comes
first. An arrival later than every register's minimum can't matter, nor can the shingle's later ones, so a
shingle stops early: after all first arrivals few shingles go on. Registers of two documents agree with
probability J_P, the probability Jaccard similarity (for equal weights the plain Jaccard similarity).
`bands` bands of `rows` registers give candidates (at J_P 0.8, 16 bands of 4 miss 1 pair in 4,500); nearby
signatures are verified on the exact J_P >= `least`.

Returned: one row for each document: class_id (least doc_id of its class) and class_size. Copies share a content. Nulls, empty texts: no shingles, each row a class of its
own. A null doc_id has the class of its content. Repeated rows are copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcintel.llm import keyset
from srcintel.llm.links import components, promises, salted, spanning, verified
from srcintel.llm.shared import keyed, ship, stash
from srcintel.llm.text import U, Words, enter, mix, steps, words

REGISTERS = 64


def shingles(hashes: np.ndarray, ptr: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingles of each text one after another, and each text's offset. Texts of fewer words: one shingle."""
    n = np.diff(ptr)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(ptr[:-1] - off[:-1], count) + np.arange(off[-1])
    end = np.repeat(ptr[1:], count)
    out = np.zeros(len(at), U)
    for k in range(width):
        pos = at + k
        word = np.where(pos < end, hashes[np.minimum(pos, max(0, len(hashes) - 1))], U(0)) if len(hashes) else out
        out = mix(out * U(0x9E3779B97F4A7C15) + word + U(k + 1))
    return out, off


def weighted(shingle: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) with equal shingles of a text put together."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((shingle, doc))
    d, s = doc[order], shingle[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(s)))


def probminhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """n_docs x registers of 32 bits: of the shingle that arrives first. doc must ascend."""
    first = np.full(n_docs * registers, np.inf)
    owner = np.zeros(n_docs * registers, np.uint32)
    active = np.arange(len(doc))
    time = np.zeros(len(doc))
    k = 0
    while len(active):
        seed = mix(shingle[active] + U((k * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) & (2**64 - 1)))
        gap = -np.log(((seed >> U(12)).astype(np.float64) + 0.5) / float(1 << 52))
        register = (seed & U(4095)).astype(np.int64) % registers
        time = time + gap / weight[active]
        slot = doc[active] * registers + register
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        owner[slot[won]] = (shingle[active[won]] >> U(32)).astype(np.uint32)
        latest = first.reshape(n_docs, registers).max(1)
        go = time < latest[doc[active]]
        active, time = active[go], time[go]
        k += 1
    return owner.reshape(n_docs, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets, each (sorted keys, weights): sum over the common i of
    1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    keys = np.union1d(a[0], b[0])
    if not len(keys):
        return 0.0
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)  # y_j / x_j; where it exceeds i's, y_j / y_i is the greater
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    x_up = np.cumsum(x)
    y_down = y.sum() - np.cumsum(y)
    common = np.flatnonzero((x > 0) & (y > 0))
    last = np.searchsorted(ratio, ratio[common], "right") - 1  # x_j / x_i counts up to ratio_i
    return float((1.0 / (x_up[last] / x[common] + y_down[last] / y[common])).sum())


def content_keys(w: Words) -> list[bytes | None]:
    """16 bytes for each text's words; null without words."""
    ptr = w.ptr.tolist()
    return [hashlib.blake2b(w.hash[p:q].tobytes(), digest_size=16).digest() if q > p else None for p, q in zip(ptr, ptr[1:])]


def signatures(docs: DataFrame, width: int = 5, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """id_columns, key (16 bytes of the words' digest; null without words), signature (64 x 32 bits)."""
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("neardup")
        for batch in steps(batches, "_text"):
            w = words(batch.column("_text"), lower=True)
            doc, shingle, weight = weighted(*shingles(w.hash, w.ptr, width))
            owner = probminhash(doc, shingle, weight, batch.num_rows)
            keys = content_keys(w)
            raw, size = owner.astype("<u4").tobytes(), 4 * REGISTERS
            sig = [raw[k * size : (k + 1) * size] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in id_columns), pa.array(keys, pa.binary()), pa.array(sig, pa.binary())], [*id_columns, "key", "signature"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in id_columns] + ["key binary", "signature binary"])
    return docs.select(*id_columns, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def _links(width: int, least: float, enough: float):
    """Verified links of a cell of (signature, content): J_P >= least, of pairs whose signatures agree in `enough`. Texts turn into weighted
    sets when they're first needed."""

    def links(rows: pa.RecordBatch, cuts: list[int], parts: list | None) -> Iterator[tuple[int, int]]:
        enter("neardup")
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u4").reshape(rows.num_rows, -1)
        texts, sets = rows.column("content"), {}

        def weighted_set(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in sets:
                w = words(texts.slice(k, 1), lower=True)
                key, count = np.unique(shingles(w.hash, w.ptr, width)[0], return_counts=True)
                sets[k] = (key, count / count.sum())
            return sets[k]

        def similar(i: int, j: int) -> bool:
            (a, x), (b, y) = weighted_set(i), weighted_set(j)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = b[at] == a
            # J_P is at most the overlap of the two distributions
            return bool(np.minimum(x[both], y[at[both]]).sum() >= least) and similarity((a, x), (b, y)) >= least

        def square(lo: int, hi: int) -> np.ndarray:
            own = signature[lo:hi]
            return np.stack([(own == one).mean(1, dtype=np.float32) for one in own])

        return spanning(cuts, lambda i, j: (signature[i] == signature[j]).mean(1), square, enough, lambda pairs: [similar(i, j) for i, j in pairs], parts)

    return links


def content_groups(docs: DataFrame, width: int = 5, least: float = 0.8, bands: int = 16, rows: int = 4, margin: float = 0.2, cell: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(id columns and key of each row of docs, (node, root) of the keys in links). docs: _k1, _k2, doc_id, text.
    margin: signatures that agree in less than least - margin (4 standard deviations) aren't verified."""
    if bands * rows > REGISTERS:
        raise ValueError(f"bands * rows must not exceed {REGISTERS}")
    signed = stash(signatures(docs, width, ("doc_id", "_k1", "_k2")), "signatures")
    items = stash(signed.where("key is not null").groupBy("key").agg(F.first("signature").alias("signature")), "items")
    band = [F.struct(F.xxhash64(F.lit(k), F.substring("signature", 4 * rows * k + 1, 4 * rows)).alias("bucket")) for k in range(bands)]
    buckets = items.select(F.explode(F.array(*band)).alias("band"), "key").select("band.bucket", "key")
    enough = least - margin
    cells = salted(buckets).distinct().join(items, "key")
    promised = components(promises(cells, "<u4", lambda a, b: (a == b).mean(1) >= enough))
    keys = promised.select(F.col("node").alias("key"))
    folder = keyset.write(keys.select(F.xxhash64("key").alias("key")))
    # the copies of a content become one row in each task, before they are exchanged
    texts = _texts(docs, folder).groupBy("key").agg(F.first("text").alias("content"))
    contents = texts.join(items, "key")
    orders = [F.substring("signature", 4 * rows * k + 1, 4 * rows) for k in (0, bands // 2)]
    return signed.drop("signature"), verified(promised, contents, _links(width, least, enough), orders, cell)


def _texts(docs: DataFrame, folder: str) -> DataFrame:
    """(key, text) of the rows whose keys, as signatures() makes them, are in the set: a mapped file, so that the other texts aren't exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = keyset.KeySet(folder)
        for batch in steps(batches):
            keys = content_keys(words(batch.column("text"), lower=True))
            some = [k for k, x in enumerate(keys) if x is not None]
            hit = wanted.contains(np.array([xxhash.xxh64_intdigest(keys[k], 42) for k in some], U))
            at = {keys[k]: k for k, h in zip(some, hit.tolist()) if h}  # of a step's copies one
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.binary()), batch.column("text").take(pa.array(list(at.values())))], ["key", "text"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key binary, text string")


#: Contents with more than one in so many of all rows are joined by broadcast (there are at most so many), so that no task gets all their copies.
HOT = 10_000


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, class_size and whether it is the one that stays (keep), with the row keys _k1, _k2."""
    plain, _ = keyed(docs, doc_id="long", text="string")
    rows, labels = content_groups(plain.select("doc_id", "text", "_k1", "_k2"), **how)
    contents = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")).alias("stays"))
    contents = contents.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    whole = contents.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.min("stays").alias("stays"))
    contents = stash(contents.drop("least", "stays").join(whole, "root").select("key", "copies", "class_id", "class_size", F.col("stays._k1").alias("s1"), F.col("stays._k2").alias("s2")), "classes")
    hot = F.col("copies") > max(HOT, rows.count() // HOT)
    some = rows.where("key is not null").join(F.broadcast(contents.where(hot)), "key", "left")
    rest = some.where("copies is null").select("doc_id", "_k1", "_k2", "key").join(contents.where(~hot), "key")
    out = some.where("copies is not null").unionByName(rest)
    keep = (F.col("_k1") == F.col("s1")) & (F.col("_k2") == F.col("s2"))
    found = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "class_size", keep.alias("keep"), "_k1", "_k2")
    empty = rows.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("keep"), "_k1", "_k2")
    return found.unionByName(empty)
