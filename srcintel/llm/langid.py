"""Language ID of mixed-language text: script ranges, per-word scores, and Viterbi with a switching penalty.

A word is a run of letters of one script, by the code points' ranges; marks belong to the letters before them, and whatever
is neither (digits, punctuation, symbols of any block, blanks) parts words. So a change of script inside a chunk begins a
new word. Scripts written without blanks (Han, kana, Thai, ...) are cut to words of PIECE letters. Model: counts of byte
trigrams around the bytes of words (A-Z lowered, all that parts words as blank) per language, over all training
documents, in 2**18 hash slots, as log probabilities smoothed towards those of all languages together; and how many
of each script's words each language has. Only languages with at least `script_share` of their words in a word's script
compete for it (all of them, where none has). A word's score for a language is the sum over its trigrams. Viterbi
over the words of a text, with a penalty for each change of language, labels spans. The text's language is
the one with most words; the score is its share of the words.

The model is a file of languages x slots in the shared folder, written in blocks of slots by the executors and mapped by
the workers: the driver holds only sums by language and script.

Nulls, empty texts and texts without a letter: `und`, score 0. Ties go to the first language by code point.
Long texts are labelled whole. Without training documents every text is `und`. Repeated rows are documents
of their own; equal texts get equal answers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcintel.llm.shared import fresh, ship, stash, tasks
from srcintel.llm.text import LOWER, as_bytes, enter, steps

SLOTS = 1 << 18
BLOCK = 1 << 14  # slots that a task writes at once
PIECE = 2  # letters of a word in scripts without blanks
PART = 1 << 19  # bytes of text whose words are scored at once; the arrays for it take many times as much
#: First code points of ranges and their scripts; a script ends where the next range begins.
RANGES = [
    (0x41, "latin"), (0x250, "latin"), (0x2B0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x750, "arabic"), (0x780, "thaana"), (0x7C0, "nko"),
    (0x800, "other"), (0x860, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"),
    (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "canadian"), (0x1680, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C00, "other"), (0x2C60, "latin"),
    (0x2C80, "coptic"), (0x2D00, "georgian"), (0x2D30, "other"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3041, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x31A0, "bopomofo"),
    (0x31C0, "han"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "yi"), (0xA4D0, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xA960, "hangul"), (0xA980, "other"),
    (0xAB30, "latin"), (0xAB70, "cherokee"), (0xABC0, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = tuple(dict.fromkeys(name for _, name in RANGES))
UNSPACED = ("han", "kana", "thai", "lao", "khmer", "myanmar", "tibetan", "bopomofo", "yi")
_MARK, _NONE = 254, 255


def _scripts() -> np.ndarray:
    """The script of each code point that is a letter; _MARK for marks, _NONE for all else."""
    out = np.full(0x110000 >> 2, _NONE, np.uint8)  # letters lie in the first quarter of the code space
    first = np.array([a for a, _ in RANGES])
    which = np.array([SCRIPTS.index(name) for _, name in RANGES], np.uint8)
    kind = np.array([unicodedata.category(chr(c))[0] for c in range(len(out))])
    letter = np.flatnonzero(kind == "L")
    out[letter] = which[np.maximum(0, np.searchsorted(first, letter, "right") - 1)]
    out[np.flatnonzero(kind == "M")] = _MARK
    out[[0x3005, 0x3007]] = SCRIPTS.index("han")
    return out


_SCRIPT = _scripts()
_SPACED = ~np.isin(np.arange(256), [SCRIPTS.index(name) for name in UNSPACED])


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, first byte) of each character of UTF-8 bytes."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    wide = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
    lead = wide[start]
    out = lead.copy()
    for low, bits, n in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        some = np.flatnonzero(lead >= low)
        value = lead[some] & bits
        for k in range(1, n + 1):
            value = value << 6 | wide[start[some] + k] & 0x3F
        out[some] = value
    return out, start


def _slots(shown: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A slot for the trigram around each byte. Blanks are before and after each text, whatever texts come next to it."""
    key = np.full(len(shown) + 1, 32, np.uint32)
    key[1:] = shown
    key[off] = 32
    after = np.full(len(shown) + 1, 32, np.uint8)
    after[:-1] = shown
    after[off] = 32
    key = key[:-1]
    for following in (shown, after[1:]):
        key <<= np.uint32(8)
        key |= following
    key *= np.uint32(0x9E3779B1)
    key >>= np.uint32(14)
    return key.view(np.int32)


def split(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with blanks for what parts words, texts' offsets, words' starts, ends, texts' ranges of words, words' scripts, whether each text has a letter)."""
    data, off = as_bytes(col)
    none = np.zeros(0, np.int64)
    if not len(data):
        return data, off, none, none, np.zeros(len(off), np.int64), none, np.zeros(len(off) - 1, bool)
    point, start = code_points(data)
    script = _SCRIPT[np.minimum(point, len(_SCRIPT) - 1)]
    letters = np.zeros(len(script) + 1, np.int64)
    np.cumsum(script < _MARK, out=letters[1:])
    of_text = np.searchsorted(start, off)  # each text's first character
    has = letters[of_text[1:]] > letters[of_text[:-1]]
    opens = np.zeros(len(start), bool)
    opens[of_text[:-1][of_text[:-1] < len(start)]] = True
    mark = script == _MARK
    if mark.any():  # as the letter before it, in the same text
        script[mark & opens] = _NONE
        mark = script == _MARK
        script = script[np.maximum.accumulate(np.where(mark, 0, np.arange(len(script))))]
    word = script != _NONE
    begins = word & (opens | np.append(True, script[1:] != script[:-1]))
    letter = np.cumsum(~mark)
    since = letter - np.maximum.accumulate(np.where(begins, letter, 0))
    begins |= word & ~_SPACED[script] & (since % PIECE == 0) & ~mark
    first = np.flatnonzero(begins)
    # a word ends where the next begins, or what parts words
    stops = np.append(np.flatnonzero(begins | ~word), len(start))
    last = stops[np.searchsorted(stops, first, "right")]
    place = np.append(start, len(data))
    size = np.diff(place)
    shown = np.where(np.repeat(word, size), LOWER[data], 32).astype(np.uint8)
    return shown, off, place[first], place[last], np.searchsorted(place[first], off), script[first], has


def train(docs: DataFrame) -> DataFrame:
    """(lang, slot, n): trigram counts, and words by script in the slots from SLOTS on, over all rows with a text and a lang."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        seen: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in seen.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "slot": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})
            seen.clear()

        for batch in steps(batches, limit=2 * PART):
            langs = batch.column("lang").dictionary_encode()
            which = langs.indices.to_numpy(zero_copy_only=False)
            shown, off, _, _, ptr, script, _ = split(batch.column("text"))
            slot, inside = _slots(shown, off), shown != 32
            of_byte = np.repeat(which, np.diff(off))
            of_word = np.repeat(which, np.diff(ptr))
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                if lang not in seen and len(seen) >= 32:
                    yield from out()
                n = seen.setdefault(lang, np.zeros(SLOTS + len(SCRIPTS), np.int64))
                n[:SLOTS] += np.bincount(slot[inside & (of_byte == k)], minlength=SLOTS)
                n[SLOTS:] += np.bincount(script[of_word == k], minlength=len(SCRIPTS))
        yield from out()

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def model(counts: DataFrame, script_share: float = 0.001) -> tuple[list[str], str, np.ndarray]:
    """(languages, file of the log probabilities by slot, languages allowed by script)."""
    spark = counts.sparkSession
    ship(spark)
    counts = stash(counts, "counts")
    grams = counts.where(F.col("slot") < SLOTS)
    known = [r["lang"] for r in counts.select("lang").distinct().collect()]  # a row for each language
    langs = sorted(known, key=lambda x: x.encode())
    index = {x: k for k, x in enumerate(langs)}
    total = np.zeros(max(1, len(langs)))
    for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        total[index[r["lang"]]] = r["n"]
    used = grams.select("slot").distinct().count()
    scripts = np.zeros((len(SCRIPTS), max(1, len(langs))))
    for r in counts.where(F.col("slot") >= SLOTS).collect():  # languages x scripts at most
        scripts[r["slot"] - SLOTS, index[r["lang"]]] = r["n"]
    allowed = scripts >= script_share * np.maximum(1, scripts.sum(0))
    allowed[~allowed.any(1)] = True
    path = f"{fresh(spark, 'langid')}/logs.npy"
    del known
    np.lib.format.open_memmap(path, "w+", np.float32, (SLOTS, max(1, len(langs)))).flush()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows are written whole, the same by whichever task writes them."""

        def close(block: int, parts: list[pa.RecordBatch]) -> None:
            n = np.zeros((BLOCK, len(total)))
            for p in parts:
                some = p.column("lang").is_valid().to_numpy(zero_copy_only=False)
                at = p.column("slot").to_numpy(zero_copy_only=False)[some].astype(np.int64) - block * BLOCK
                np.add.at(n, (at, [index[x] for x in p.column("lang").to_pylist() if x is not None]), p.column("n").to_numpy(zero_copy_only=False)[some])
            # what a language hasn't shown weighs as in all languages together, so that small ones gain nothing by it
            pooled = (n.sum(1, keepdims=True) + 0.5) / (total.sum() + 0.5 * (used + 1))
            logs = np.log(0.9 * n / np.maximum(1, total) + 0.1 * pooled)
            file = np.lib.format.open_memmap(path, "r+")
            file[block * BLOCK : (block + 1) * BLOCK] = logs
            file.flush()

        block, held = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if block is not None and blocks[lo] != block:
                        close(block, held)
                        held = []
                    block = int(blocks[lo])
                    held.append(batch.slice(lo, hi - lo))
        if block is not None:
            close(block, held)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32())})

    every = spark.range(SLOTS // BLOCK).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("n"), F.col("id").cast("int").alias("block"))
    rows = grams.select("lang", "slot", "n", F.expr(f"slot div {BLOCK}").cast("int").alias("block")).unionByName(every)
    rows.repartition(min(SLOTS // BLOCK, tasks(spark)), "block").sortWithinPartitions("block").mapInArrow(save, "block int").count()
    return langs, path, allowed


def viterbi(score: np.ndarray, ptr: np.ndarray, penalty: float) -> np.ndarray:
    """The best state for each word. score: words x states; ptr: each text's range of words. All texts of a
    step advance together, word by word, the longest first, so that the active ones stay a prefix."""
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    first, length = ptr[:-1][order], size[order]
    label = np.zeros(len(score), np.int16)
    if not len(order):
        return label
    longer = np.searchsorted(-length, -np.arange(length[0] + 1), "left").tolist()  # texts of more than t words
    stay = np.ones(score.shape, bool)  # it is best to come from the same state
    lead = np.zeros(len(score), np.int16)  # else from this one
    final = np.zeros(len(order), np.int64)
    value = score[first].astype(np.float64)
    final[longer[1] :] = value[longer[1] :].argmax(1)
    row = np.arange(len(order))
    for t in range(1, len(longer) - 1):
        n = longer[t]
        at, value = first[:n] + t, value[:n]
        top = value.argmax(1)
        jump = (value[row[:n], top] - penalty)[:, None]
        lead[at] = top
        stay[at] = value >= jump
        value = np.maximum(value, jump) + score[at]
        done = longer[t + 1]
        if done < n:
            final[done:n] = value[done:].argmax(1)
    for t in range(len(longer) - 2, -1, -1):
        n = longer[t]
        at, now = first[:n] + t, final[:n]
        label[at] = now
        if t:
            final[:n] = np.where(stay[at, now], now, lead[at])
    return label


def word_scores(col: pa.Array, logs: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of scores for each word, each text's range of words, the words' byte ranges in the text column, and which texts have letters."""
    shown, off, start, end, ptr, script, has = split(col)
    if not len(start):
        return np.zeros((0, logs.shape[1]), np.float32), ptr, start, end, has
    each = logs[_slots(shown, off)[shown != 32]]
    size = end - start
    score = np.add.reduceat(each, np.cumsum(size) - size, axis=0)
    score[~allowed[script]] = -1e6
    return score, ptr, start, end, has


def label_words(col: pa.Array, logs: np.ndarray, allowed: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language of each word, each text's range of words, starts, ends in the column's bytes, whether each text has a letter)."""
    parts, ptrs, starts, ends, letters, seen, bytes_seen = [], [np.zeros(1, np.int64)], [], [], [], 0, 0
    for b in steps(iter([pa.RecordBatch.from_arrays([col], ["text"])]), limit=PART):
        score, ptr, start, end, has = word_scores(b.column(0), logs, allowed)
        parts.append(score)
        ptrs.append(ptr[1:] + seen)
        starts.append(start + bytes_seen)
        ends.append(end + bytes_seen)
        letters.append(has)
        seen += len(score)
        bytes_seen += len(as_bytes(b.column(0))[0])
    score, ptr, start, end, has = [np.concatenate(x) for x in (parts, ptrs, starts, ends, letters)]
    del parts, starts, ends  # else they are held twice while viterbi() runs
    return viterbi(score, ptr, penalty), ptr, start, end, has


def predict(docs: DataFrame, languages: list[str], logs: str, allowed: np.ndarray, penalty: float = 12.0, id_columns: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """id_columns with lang_pred and score; spans: with an array of (lang, start, end), byte ranges of the text."""
    spark = docs.sparkSession
    ship(spark)
    schema = T.StructType([docs.schema[c] for c in id_columns]).add("lang_pred", "string").add("score", "double")
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType().add("lang", "string").add("start", "long").add("end", "long")))
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        table = np.load(logs, mmap_mode="r")
        names = np.array([*languages, "und"], object)
        for batch in steps(batches, "_text", 6 << 20):
            col = batch.column("_text")
            label, ptr, start, end, has = label_words(col, table, allowed, penalty)
            size, n, wide = np.diff(ptr), batch.num_rows, max(1, len(languages))
            votes = np.bincount(np.repeat(np.arange(n), size) * wide + label, minlength=n * wide).reshape(n, wide)
            best = votes.argmax(1)
            score = votes.max(1) / np.maximum(1, size)
            sure = has & (size > 0) & bool(languages)
            out = [batch.column(c) for c in id_columns] + [pa.array(names[np.where(sure, best, len(languages))], pa.string()), pa.array(np.where(sure, score, 0.0))]
            if spans:
                off = as_bytes(col)[1]
                found = []
                for k in range(n):
                    lo, hi = int(ptr[k]), int(ptr[k + 1])
                    cuts = [lo, *(np.flatnonzero(np.diff(label[lo:hi])) + lo + 1).tolist(), hi]
                    found.append([{"lang": names[label[a]], "start": int(start[a] - off[k]), "end": int(end[b - 1] - off[k])} for a, b in zip(cuts, cuts[1:])] if sure[k] else [])
                out.append(pa.array(found, span_type))
            yield pa.RecordBatch.from_arrays(out, [*id_columns, "lang_pred", "score", *["spans"] * spans])

    return docs.select(*id_columns, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def identify(docs: DataFrame, training: DataFrame | None = None, id_columns: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """Learns from `training` (docs with a lang), predicts for all docs."""
    return predict(docs, *model(train(docs if training is None else training)), id_columns=id_columns, **how)
