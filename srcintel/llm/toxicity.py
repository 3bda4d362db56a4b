"""Toxicity by classifier chains: one linear model after another, each fed the earlier categories' probabilities.

Training, on at most `most_rows` labelled texts (those of least hash of doc_id; a documented bound, which holds however often a
doc_id or a text is there; copies count once), in one task: features are the presence of words (runs of letters, lower case), the `most_words` with the highest G2 against the category among those in
`least_docs` texts or more, and a few shares of the text (symbols, capitals, digits, distinct words). A category's
model is logistic regression with an L1 penalty (FISTA), refitted on the words that it kept. Probabilities that train
the later models are out of fold (`folds` folds by hash), so they have the spread that they'll have on new texts;
prediction uses the model of all rows. The model, some kilobytes, is broadcast; scoring is one pass over the documents.

Null, empty texts: no words; probability 0 of every category. Labels of rows without a document, and null labels, don't
count. Without both classes in a category its probability is its share in training. Equal texts get equal answers.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcintel.llm.repetition import SYMBOL
from srcintel.llm.shared import ship, stash
from srcintel.llm.text import SPACE, U, as_bytes, enter, per_text, range_hash, runs, steps

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_DOWN = np.arange(256, dtype=np.uint8)
_DOWN[65:91] += 32


def extract(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word hashes of the texts one after another, each ascending; offsets; shares of each text)."""
    data, off = as_bytes(col)
    start, end, ptr = runs(_LETTER[data], off)
    word = range_hash(_DOWN[data], start, end)
    doc = np.repeat(np.arange(len(col)), np.diff(ptr))
    order = np.lexsort((word, doc))
    word, doc = word[order], doc[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
    word, doc = word[new], doc[new]
    distinct = np.bincount(doc, minlength=len(col))
    size = np.maximum(1, np.diff(off))
    share = [per_text(x.astype(np.int64), off) / size for x in (SYMBOL[data], (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), SPACE[data])]
    n = np.diff(ptr)
    dense = np.stack([*share, distinct / np.maximum(1, n), np.log1p(n) / 10], 1)
    return word, np.concatenate([[0], np.cumsum(distinct)]), dense


class Rows:
    """Sparse 0/1 columns and dense ones."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n_cols: int, dense: np.ndarray):
        self.row, self.col, self.n, self.k, self.dense = row, col, len(dense), n_cols, dense

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[: self.k][self.col], self.n) + self.dense @ w[self.k :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, r[self.row], self.k), self.dense.T @ r])

    def take(self, keep: np.ndarray) -> "Rows":
        place = np.cumsum(keep) - 1
        hit = keep[self.row]
        return Rows(place[self.row[hit]], self.col[hit], self.k, self.dense[keep])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: Rows, y: np.ndarray, l1: float, l2: float = 1e-6, iterations: int = 150, allowed: np.ndarray | None = None) -> np.ndarray:
    """Weights of an L1 logistic regression (the last dense column is the constant, unpenalised), by FISTA."""
    size = x.k + x.dense.shape[1]
    allowed = np.ones(size, bool) if allowed is None else allowed
    v = np.ones(size) / np.sqrt(size)
    for _ in range(12):
        v = x.back(x.times(v * allowed)) * allowed
        norm = np.linalg.norm(v)
        if norm == 0:
            break
        v /= norm
    step = 1 / (0.3 * norm / x.n + l2 + 1e-12)
    penalty = np.full(size, l1)
    penalty[-1] = 0
    w = ahead = np.zeros(size)
    t = 1.0
    for _ in range(iterations):
        gradient = x.back(_sigmoid(x.times(ahead)) - y) / x.n + l2 * ahead
        new = ahead - step * gradient
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty) * allowed
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def _fit(x: Rows, y: np.ndarray, l1: float) -> np.ndarray:
    """L1 selects, a fit with a tenth of the penalty follows on what it kept."""
    if y.min() == y.max():
        out = np.zeros(x.k + x.dense.shape[1])
        out[-1] = -40.0 if y.max() == 0 else 40.0
        return out
    first = logistic(x, y, l1)
    kept = np.abs(first) > 1e-3
    kept[x.k :] = True
    return logistic(x, y, l1 / 10, iterations=400, allowed=kept)


def _telling(word: np.ndarray, row: np.ndarray, y: np.ndarray, least_docs: int, most_words: int) -> np.ndarray:
    """The words, ascending, with the highest G2 of presence against y."""
    distinct, which, df = np.unique(word, return_inverse=True, return_counts=True)
    a = np.bincount(which, y[row], len(distinct))  # present and positive
    n, p = len(y), y.sum()
    table = [(a, df * p / n), (df - a, df * (n - p) / n), (p - a, (n - df) * p / n), (n - p - df + a, (n - df) * (n - p) / n)]
    g2 = sum(2 * o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)) for o, e in table)
    g2[df < least_docs] = -1
    best = np.argsort(-g2, kind="stable")[:most_words]
    return np.sort(distinct[best[g2[best] > 0]])


def _columns(words: np.ndarray, word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(words):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(words, word), len(words) - 1)
    hit = words[at] == word
    return row[hit], at[hit]


def _with(dense: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([dense, *earlier, np.ones(len(dense))])


def fit_chain(word: np.ndarray, row: np.ndarray, dense: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int, l1: float, least_docs: int, most_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, weights) of each category (columns of labels, in the order of the chain)."""
    out, earlier = [], []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        chosen = _telling(word, row, y, least_docs, most_words)
        r, c = _columns(chosen, word, row)
        x = Rows(r, c, len(chosen), _with(dense, earlier))
        out.append((chosen, _fit(x, y, l1)))
        if k + 1 < labels.shape[1]:
            unseen = np.zeros(len(y))
            for f in range(folds):
                test = fold == f
                if test.any() and not test.all():
                    # the words, too, are chosen without the fold
                    inner = _telling(word[~test[row]], (np.cumsum(~test) - 1)[row[~test[row]]], y[~test], least_docs, most_words)
                    r, c = _columns(inner, word, row)
                    whole = Rows(r, c, len(inner), x.dense)
                    unseen[test] = _sigmoid(whole.take(test).times(_fit(whole.take(~test), y[~test], l1)))
            earlier.append(unseen)
    return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most_rows: int = 20_000, folds: int = 5, l1: float = 3e-4, least_docs: int = 3, most_words: int = 4096) -> list[tuple[np.ndarray, np.ndarray]]:
    """docs: doc_id, text; labels: doc_id and the label columns. categories: name -> 0/1 column of labels, in the order of the chain."""
    spark = docs.sparkSession
    ship(spark)
    names = list(categories)
    y = [c.cast("double").alias(f"y{k}") for k, c in enumerate(categories.values())]
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("hash"), *y).dropna().orderBy("hash", "doc_id", *[f"y{k}" for k in range(len(names))]).limit(most_rows)
    # most_rows small rows at most are broadcast, twice: the documents stay where they are, only the sample's words travel
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    content = F.xxhash64("text").alias("content")
    found = texts.join(F.broadcast(sample), "doc_id").select(content, "hash", *[f"y{k}" for k in range(len(names))])
    # a document that is there many times, or a text with many labels, is one row: that of the least hash
    own = F.struct("hash", *[f"y{k}" for k in range(len(names))])
    chosen = stash(found.groupBy("content").agg(F.min(own).alias("own")).orderBy("own", "content").limit(most_rows), "sample")
    once = texts.select(content, "text").join(F.broadcast(chosen), "content").groupBy("content").agg(F.first("text").alias("text"), F.first("own").alias("own"))
    sample = once.select("content", "text", "own.*")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch in steps(batches):
            word, off, dense = extract(batch.column("text"))
            raw, bound = word.astype("<u8").tobytes(), (8 * off).tolist()
            y = np.stack([batch.column(f"y{k}").to_numpy() for k in range(len(names))], 1)
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("content"), pa.array([raw[a:b] for a, b in zip(bound, bound[1:])], pa.binary()), pa.array(dense.tolist()), pa.array(y.tolist())], ["hash", "content", "words", "dense", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        each = table.column("words").to_pylist()
        word = np.frombuffer(b"".join(each), "<u8").astype(U)
        row = np.repeat(np.arange(len(each)), [len(x) // 8 for x in each])
        fold = np.array(table.column("hash").to_pylist(), np.int64) % folds
        chain = fit_chain(word, row, np.array(table.column("dense").to_pylist()), np.array(table.column("y").to_pylist()), fold, folds, l1, least_docs, most_words)
        buffer = io.BytesIO()
        np.savez(buffer, **{f"{part}{k}": a for k, pair in enumerate(chain) for part, a in zip("cw", pair)})
        yield pa.RecordBatch.from_arrays([pa.array([buffer.getvalue()], pa.binary())], ["model"])

    shrunk = sample.mapInArrow(shrink, "hash long, content long, words binary, dense array<double>, y array<double>")
    found = shrunk.repartition(1).sortWithinPartitions("hash", "content").mapInArrow(fit, "model binary").first()  # most_rows rows at most
    if found is None:
        return [(np.zeros(0, U), np.zeros(0)) for _ in names]
    z = np.load(io.BytesIO(found[0]))
    return [(z[f"c{k}"], z[f"w{k}"]) for k in range(len(names))]


def predict(docs: DataFrame, chain: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> DataFrame:
    """doc_id and p_<category> of each document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        chain = shared.value
        for batch in steps(batches):
            word, off, dense = extract(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(off))
            some = np.diff(off) > 0
            earlier: list[np.ndarray] = []
            for words, weights in chain:
                if not len(weights):
                    earlier.append(np.zeros(batch.num_rows))
                    continue
                r, c = _columns(words, word, row)
                p = _sigmoid(Rows(r, c, len(words), _with(dense, earlier)).times(weights))
                earlier.append(np.where(some, p, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, earlier)], ["doc_id", *(f"p_{n}" for n in names)])

    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic: the chain low quality -> toxic over the labels table."""
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    found = predict(docs, train(docs, labels, categories, **how), list(categories))
    return found.withColumn("toxic", F.col("p_toxic") >= threshold)
