"""Quality rules on repetition: suffix arrays and LCP intervals over a text's words.

For each text, the suffixes of its sequence of words are sorted by prefix doubling (Larsson-Sadakane: only
groups of suffixes that are still equal are sorted again), many texts at a time, since a suffix ends with its
text. The longest common prefix of neighbouring suffixes follows from the ranks of each doubling, the largest
first. An LCP interval of l words stands for a maximal repeated substring; the longest of those that begin at a
word is the greater LCP with its two neighbours in suffix order, so the union of the spans of all maximal repeats
of `shortest` words or more is the union of these. A text fails when the union covers more than `most_covered` of
its words, or a repeat is longer than `longest` words.

Base rule: fails with under `fewest` words, or more than half of the words in 3-word windows found twice or more.
Nulls and texts without words: 0 words, fail. Texts are used whole, whatever their length; equal texts get equal
answers; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcintel.llm.shared import ship
from srcintel.llm.text import SPACE, Words, enter, per_text, steps, words

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def suffix_order(token: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes and, for each k, numbers equal where the first 2**k tokens are equal and inside the text.

    token: the integer of each position, unequal between texts; stop: where each position's text ends."""
    n = len(token)
    order = np.argsort(token, kind="stable")
    new = np.ones(n, bool)
    new[1:] = token[order[1:]] != token[order[:-1]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    levels = [rank.copy()]
    h = 1
    active = order[_in_groups(group, n)]
    while len(active):
        follow = active + h
        second = np.where(follow < stop[active], rank[np.minimum(follow, n - 1)] + 1, 0)
        first = rank[active]
        key = (first << 32) | second
        by = np.argsort(key, kind="stable")
        active, key, first = active[by], key[by], first[by]
        place = np.arange(len(active))
        old = np.ones(len(active), bool)
        old[1:] = first[1:] != first[:-1]
        sub = np.ones(len(active), bool)
        sub[1:] = key[1:] != key[:-1]
        moved = np.maximum.accumulate(np.where(sub, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
        rank[active] = first + moved
        h *= 2
        last = np.append(sub[1:], True)
        active = active[~(sub & last)]
        if len(active):
            levels.append(rank.copy())
    return rank, levels


def _in_groups(group: np.ndarray, n: int) -> np.ndarray:
    alone = np.ones(n, bool)
    if n:
        alone[1:] = group[1:] != group[:-1]
        alone &= np.append(alone[1:], True)
    return ~alone


def longest_repeats(token: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each position, the most tokens from it on that occur elsewhere in its text too."""
    n = len(token)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    rank, levels = suffix_order(token, stop)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    a, b = suffix[:-1], suffix[1:]
    same = levels[0][a] == levels[0][b]
    a, b = a[same], b[same]
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        ok = (x < stop[a]) & (y < stop[b])
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        length[ok] += 1 << k
    np.maximum.at(out, a, length)
    np.maximum.at(out, b, length)
    return out


def covered(repeat: np.ndarray, least: int, window: int | None = None) -> np.ndarray:
    """The positions inside the spans of repeats of `least` or more (their first `window` tokens)."""
    at = np.flatnonzero(repeat >= least)
    edge = np.zeros(len(repeat) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (repeat[at] if window is None else window), -1)
    return np.cumsum(edge[:-1]) > 0


def features(w: Words, shortest: int) -> dict[str, np.ndarray]:
    n_docs = len(w.ptr) - 1
    size = np.diff(w.ptr)
    doc = w.doc
    token = np.unique(w.hash, return_inverse=True)[1] + doc * (len(w.hash) + 1)
    repeat = longest_repeats(token, np.repeat(w.ptr[1:], size))
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc, repeat)
    head = (w.data & 0xC0) != 0x80
    out = {
        "n_words": size.astype(np.int64),
        "word_chars": per_text((head & ~SPACE[w.data]).astype(np.int64), w.off),
        "n_symbols": per_text(SYMBOL[w.data].astype(np.int64), w.off),
        "n_repeat_words": per_text(covered(repeat, 3, 3).astype(np.int64), w.ptr),
        "covered_words": per_text(covered(repeat, shortest).astype(np.int64), w.ptr),
        "longest_repeat": longest,
    }
    return out


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def score(docs: DataFrame, shortest: int = 5, most_covered: float = 0.3, longest: int = 100, fewest: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("repetition")
        for batch in steps(batches):
            col = batch.column("text")
            found = features(words(col), shortest)
            found["n_dup_lines"] = np.array([repeated_lines(x) for x in col.to_pylist()], np.int64)
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in names)], ["doc_id", *names])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + COLUMNS)
    failed = (F.col("n_words") < fewest) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
