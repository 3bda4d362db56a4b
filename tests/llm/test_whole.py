"""Whole operators and pipeline stages against brute force in plain Python, and tables whose columns have the operators' own names."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from srcintel.llm import kneser_ney, langid, lines, mixing, mjpeg, neardup, packing, repair, repetition, toxicity
from srcintel.llm.bpe import ChunkEncoder, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0d]+")
END, START = ("end",), ("start",)


def words(text):
    return WORD.findall(text or "")


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


# --- op1 -----------------------------------------------------------------------------------------------------


def discounts(counts):
    n = [0] + [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if not n[1]:
        return [0, 0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else y for k in (1, 2, 3)]
    return [0] + [min(x, k) if x > 0 else y for k, x in enumerate(d, 1)]


class Plain:
    """Interpolated modified Kneser-Ney bigrams by dictionaries."""

    def __init__(self, texts):
        docs = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)] + [END] for t in texts]
        self.unigram = Counter(w for d in docs for w in d)
        self.bigram = Counter(p for d in docs for p in zip([START, *d], d))
        self.n, self.v = sum(self.unigram.values()), len(self.unigram)
        self.after, self.before = defaultdict(Counter), Counter(w for _, w in self.bigram)
        for (v, w), c in self.bigram.items():
            self.after[v][w] = c
        self.d, self.low = discounts(list(self.bigram.values())), discounts(list(self.before.values()))

    def p(self, v, w):
        types = len(self.bigram)
        d = lambda c, ds: ds[min(c, 3)]
        left = sum(d(c, self.low) for c in self.before.values()) / types
        n = self.before[w]
        low = max(0, n - d(n, self.low)) / types + left / (self.v + 1)
        seen = self.after.get(v)
        if not seen:
            return low
        total = sum(seen.values())
        c = seen[w] if w in seen else 0
        return max(0, c - d(c, self.d)) / total + sum(d(x, self.d) for x in seen.values()) / total * low

    def score(self, text):
        d = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)] + [END]
        base = sum(math.log10((self.unigram[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in d)
        return len(d), sum(w in self.unigram for w in d), base, sum(math.log10(self.p(v, w)) for v, w in zip([START, *d], d))


def test_kneser_ney_against_dictionaries(spark):
    rnd = random.Random(1)
    vocabulary = [f"w{k}" if k % 3 else f"Wörd{k}" for k in range(60)]
    texts = [" ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rnd.randint(0, 60))) for _ in range(80)] + [None, "", "never seen before", "w1 w2"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in kneser_ney.train_and_score(df, df.where("doc_id < 60")).collect()}
    plain = Plain(texts[:60])
    for k, t in enumerate(texts):
        n, known, base, score = plain.score(t)
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (n, known, plain.n)
        assert got[k]["base_score"] == pytest.approx(base, rel=1e-9) and got[k]["score"] == pytest.approx(score, rel=1e-9)
    for v in [START, "w1", "w2", "never"]:
        assert sum(plain.p(v, w) for w in [*plain.unigram, "never"]) == pytest.approx(1)


def test_a_vocabulary_beyond_the_ids_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MOST_TYPES", 4)
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    with pytest.raises(ValueError):
        kneser_ney.train_and_score(df, df)


# --- op2 -----------------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_lines(texts):
    """The texts that are left: of lines of a-z, digits and single blanks."""
    places = [(d, k, line) for d, text in enumerate(texts) for k, line in enumerate(text.split("\n")) if line]
    near = []
    for i, (_, _, a) in enumerate(places):
        for j in range(i):
            b = places[j][2]
            n = max(len(a), len(b))
            if n - min(len(a), len(b)) <= 0.2 * n and levenshtein(a, b) <= int(n * 0.2 + 1e-9):
                near.append((i, j))
    root = components(len(places), near)
    gone = {(d, k) for i, (d, k, _) in enumerate(places) if root[i] != i}
    left = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in enumerate(texts)}
    return {d: t for d, t in left.items() if words(t) or not words(texts[d])}


def line_corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(300)]
    pool = [" ".join(rnd.choices(vocabulary, k=rnd.randint(8, 30))) for _ in range(25)]

    def line():
        base = rnd.choice(pool).split(" ")
        if rnd.random() < 0.6:
            base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
        return " ".join(base) if rnd.random() < 0.7 else " ".join(rnd.choices(vocabulary, k=rnd.randint(8, 30)))

    return ["\n".join(line() for _ in range(rnd.randint(1, 4))) for _ in range(25)] + ["", "invoice 2023 page 17 of 40 total 1200", "invoice 2023 page 18 of 40 total 1200"]


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_lines_against_all_pairs(spark, seed):
    """Candidates are found with a probability, 0.8 for a pair at the threshold in short lines: nothing is cut that all pairs would leave, and of what they cut nearly all."""
    import corpus_pipeline

    texts = line_corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    want = brute_lines(texts)
    count = lambda left: sum(len([x for x in t.split("\n") if x]) for t in left.values())
    every = count(dict(enumerate(texts)))
    assert want.keys() <= got.keys() and all(set(t.split("\n")) <= set(got[d].split("\n")) for d, t in want.items())
    assert every - count(got) >= 0.9 * (every - count(want)) > 12


def test_crowded_buckets_and_large_components(spark, monkeypatch):
    """The ways of buckets beyond one task and of components beyond a cell give the same."""
    from srcintel.llm import links

    texts = line_corpus(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_lines(texts)
    monkeypatch.setattr(links, "CELL", 2)
    assert {r["doc_id"]: r["text"] for r in lines.dedup(df, cell=2).collect()} == want


# --- op3 -----------------------------------------------------------------------------------------------------


def probability_jaccard(x, y):
    a, b = sum(x.values()), sum(y.values())
    x, y = {k: v / a for k, v in x.items()}, {k: v / b for k, v in y.items()}
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())


def near_corpus():
    rnd = random.Random(7)
    vocabulary = [f"t{k}" for k in range(400)]
    texts = []
    for _ in range(14):
        base = rnd.choices(vocabulary, k=rnd.randint(30, 120))
        for _ in range(rnd.randint(1, 4)):
            other = list(base)
            for _ in range(rnd.randint(0, 4)):
                other[rnd.randrange(len(other))] = rnd.choice(vocabulary)
            texts.append(" ".join(other))
    return texts + [texts[0], None, "", " ", "a b", "A  b"]


def test_near_duplicates_against_all_pairs(spark):
    import corpus_pipeline

    texts = near_corpus()
    sets = []
    for t in texts:
        w = [x.lower() for x in words(t)]
        sets.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and probability_jaccard(sets[i], sets[j]) >= 0.8]
    root = components(len(texts), links)
    size = Counter(root)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["keep"]) for r in neardup.classes(df).collect()}
    assert got == {k: (r, size[r], k == r) for k, r in enumerate(root)}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == set(root)


def test_hot_texts_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    texts = ["one two three four five six"] * 40 + ["one two three four five nine"] + [None] * 5 + ["other words are in this one here"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = Counter(r["class_size"] for r in neardup.classes(df).collect())
    assert size == {40: 40, 1: 6, 2: 2}


# --- op7 -----------------------------------------------------------------------------------------------------


def test_later_categories_learn_from_out_of_fold_probabilities(monkeypatch):
    rnd = np.random.default_rng(8)
    n, folds = 200, 4
    texts = [" ".join(rnd.choice(list("pqrstuv"), 8)) + (" bad" if rnd.random() < 0.3 else "") for k in range(n)]
    word, off, dense = toxicity.extract(pa.array(texts))
    row = np.repeat(np.arange(n), np.diff(off))
    y = np.array([("bad" in t) != (rnd.random() < 0.15) for t in texts], float)
    labels = np.stack([y, rnd.random(n) < 0.5], 1).astype(float)
    fold = rnd.integers(0, folds, n)
    seen = []
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda x, y, l1: seen.append(x) or fit(x, y, l1))
    toxicity.fit_chain(word, row, dense, labels, fold, folds, 3e-4, 2, 50)
    column = seen[-1].dense[:, dense.shape[1]]  # of the second category's own fit: the first one's probabilities
    want = np.zeros(n)
    for f in range(folds):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        w, o, d = toxicity.extract(pa.array([texts[k] for k in train]))
        r = np.repeat(np.arange(len(train)), np.diff(o))
        chosen = toxicity._telling(w, r, y[train], 2, 50)
        model = fit(toxicity.Rows(*toxicity._columns(chosen, w, r), len(chosen), toxicity._with(d, [])), y[train], 3e-4)
        w, o, d = toxicity.extract(pa.array([texts[k] for k in test]))
        r = np.repeat(np.arange(len(test)), np.diff(o))
        want[test] = toxicity._sigmoid(toxicity.Rows(*toxicity._columns(chosen, w, r), len(chosen), toxicity._with(d, [])).times(model))
    whole = fit(seen[0], y, 3e-4)
    assert np.abs(column - want).max() < 1e-9 and np.abs(column - toxicity._sigmoid(seen[0].times(whole))).max() > 1e-3


def test_logistic_regression_against_gradients():
    rnd = np.random.default_rng(3)
    x = toxicity.Rows(np.repeat(np.arange(80), 2), rnd.integers(0, 6, 160), 6, np.ones((80, 1)))
    y = (rnd.random(80) < 0.4).astype(float)
    w = toxicity.logistic(x, y, 1e-2, iterations=4000)
    g = x.back(toxicity._sigmoid(x.times(w)) - y) / 80
    assert abs(g[-1]) < 1e-5 and all(abs(g[k] + 1e-2 * np.sign(w[k])) < 1e-5 if abs(w[k]) > 1e-6 else abs(g[k]) <= 1e-2 + 1e-5 for k in range(6))


def test_toxicity_bounds_its_sample(spark):
    """A document that is there many times, copies, ties, long texts and extra columns."""
    rows = [(k % 40, f"word{k % 7} {'idiot' if k % 2 else 'fine'} item{k}", "x", 1) for k in range(400)] + [(7, "word1 idiot item1", "x", 1)] * 50 + [(99, "fine " * 30_000, "x", 1), (98, None, "x", 1), (None, "idiot", "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, hash string, content int")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)] * 2, "doc_id long, quality int, toxic int")
    seen = []
    fit = toxicity.fit_chain

    chain = toxicity.train(d, labels, {"toxic": labels["toxic"]}, most_rows=60)
    assert len(chain) == 1
    got = toxicity.detect(d, labels, most_rows=60)
    assert got.count() == len(rows)
    by = {(r["doc_id"], r["toxic"]) for r in got.collect()}
    assert (None, True) in by and (98, False) in by and (99, False) in by and not seen and fit


# --- op8 -----------------------------------------------------------------------------------------------------


def test_rates_against_a_solver(spark):
    rnd = random.Random(4)
    sizes = {"a": [rnd.randint(1, 90) for _ in range(60)], "b": [rnd.randint(1, 9) for _ in range(200)], None: [5] * 30 + [700], "c": [3] * 4}
    rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    order = sorted(sizes, key=lambda s: (s is None, s))
    total, level, capped = sum(map(sum, sizes.values())), 0.0, None
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    while capped is None or capped != {s for s in order if level * weight[s] > 3 * sum(sizes[s])}:
        capped = {s for s in order if level * weight[s] > 3 * sum(sizes[s])}
        level = (total - 3 * sum(sum(sizes[s]) for s in capped)) / sum(weight[s] for s in order if s not in capped)
    for s in order:
        target, ns = min(3 * sum(sizes[s]), level * weight[s]), sizes[s]
        scale = sum(ns) / len(ns)
        low, high = -200.0, 200.0
        for _ in range(200):  # the tilt by bisection
            tilt = (low + high) / 2
            if sum(n * min(3, math.exp(min(50, tilt * n / scale))) for n in ns) < target:
                low = tilt
            else:
                high = tilt
        mine = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(target, rel=1e-12) for r in mine) and len(mine) == len(ns)
        for r in mine:
            rate = 3 if target >= 3 * sum(ns) else min(3, math.exp(min(50, tilt * r["size"] / scale)))
            assert math.floor(rate - 1e-4) <= r["copies"] <= math.ceil(rate + 1e-4) and r["taken"] == r["copies"] * r["size"]
        assert abs(sum(r["taken"] for r in mine) - target) <= max(ns)


def test_many_sources_are_numbered_in_order(spark):
    names = [f"s{k:04d}" for k in range(500)] + ["é", "漢", "Z", "", None]
    df = spark.createDataFrame([(n, 1, 1) for n in names], "source string, source_size long, docs long").repartition(7)
    got = {r["source"]: r["number"] for r in mixing.numbered(df).collect()}
    assert got == {n: k for k, n in enumerate(sorted(names, key=lambda x: (x is None, (x or "").encode())))}


# --- tables of any kind --------------------------------------------------------------------------------------

CLASHING = ["_k1", "_k2", "_copies", "_copy", "_cut_lines", "_text", "n_lines", "n_removed", "root", "key", "c0", "c1", "cut", "left", "copies", "copy", "hash", "bucket", "size", "content", "run", "records", "part", "a `b`", "class_id", "keep"]


@pytest.fixture(scope="module")
def clashing(spark):
    rnd = random.Random(9)
    texts = line_corpus(4)[:12] + ["der hund und die katze " * 9, "the cat and the dog " * 9, None, "", "x" * 5000, " ".join(f"w{k}" for k in range(3000))]
    rows = []
    for k, t in enumerate(texts):
        rows.append((k, t, "de" if k == 12 else "en", f"s{k % 3}" if k % 4 else None, len(t or ""), *[rnd.randint(0, 5) for _ in CLASHING], {"m": "x"}))
    rows += [rows[3], rows[3]]
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars int", *("`" + c.replace("`", "``") + "` int" for c in CLASHING), "extra map<string, string>"])
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def test_stages_with_clashing_names(spark, clashing):
    import corpus_pipeline

    now, plain = clashing, clashing.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        now, plain = stage(spark, now, ""), stage(spark, plain, "")
        if name == "pack":
            break
        assert now.columns == clashing.columns
        # of rows that are equal without the other columns, near-dedup may keep another one
        assert Counter(r["text"] for r in now.collect()) == Counter(r["text"] for r in plain.collect()), name
    assert now.count() == plain.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing.where("false"), "").count() == 0, name


def test_operators_with_clashing_names(spark, clashing):
    n = clashing.count()
    labels = spark.createDataFrame([(k, k % 2, k % 3 > 1) for k in range(12)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) as toxic")
    assert kneser_ney.train_and_score(clashing, clashing).count() == n
    cleaned = lines.cleaned(clashing)
    assert cleaned.count() == n and cleaned.columns == [c for c in clashing.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    assert neardup.classes(clashing).count() == n and mjpeg.clips(clashing).count() == n and repetition.score(clashing).count() == n
    assert toxicity.detect(clashing, labels).count() == n and mixing.mix(clashing).count() == n and langid.identify(clashing).count() == n
    encoded = repair.encode(clashing).collect()
    pieces = packing.pack(clashing).collect()
    e = ChunkEncoder.at(tokenizer_path()).tokenizer
    want = sum(len(e.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in clashing.select("text").collect())
    assert len(encoded) == n and sum(r["n_tokens"] for r in encoded) == sum(r["length"] for r in pieces) == want


def test_media_columns_become_clip_rows(spark):
    frames = mjpeg.encode_frames(np.repeat(np.array([[10] * 192, [200] * 192], np.uint8), [6, 5], axis=0))
    whole = mjpeg.avi(frames)
    noindex = whole[: whole.rindex(b"idx1")]
    rows = [(1, whole, 5), (2, noindex, 5), (3, whole[:900], 5), (4, b"", 5), (5, None, 5), (6, b"RIFF0000AVI ", 5)]
    df = spark.createDataFrame(rows, "doc_id long, media binary, clip int")
    got = defaultdict(list)
    for r in mjpeg.read_clips(df).collect():
        got[r["doc_id"]].append((r["clip"], r["start"], r["end"], r["frames"], r["error"]))
    two = [(0, 0.0, 6 / 25, 6, None), (1, 6 / 25, 11 / 25, 5, None)]
    assert sorted(got[1]) == sorted(got[2]) == two
    assert all(len(got[k]) == 1 and got[k][0][4] for k in (3, 4, 5, 6)) and got[5][0][4] == "no media"
    assert mjpeg.read_clips(df.where("false")).count() == 0
    texts = spark.createDataFrame([(1, "a" * 5000 + "\n" + "é" * 3000), (2, None)], "doc_id long, text string")
    clips = mjpeg.clip_rows(texts).collect()
    assert {r["doc_id"] for r in clips} == {1, 2} and all(r["end"] > r["start"] for r in clips)
