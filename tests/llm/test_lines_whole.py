"""Line dedup against brute force: all pairs of lines by edit similarity."""

import random

from srcintel.llm import lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(texts, least=0.8):
    """The (document, line) that goes, of lines of letters a-z and single blanks."""
    places = [(d, k, line) for d, text in enumerate(texts) for k, line in enumerate(text.split("\n")) if line]
    root = list(range(len(places)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, _, a) in enumerate(places):
        for j in range(i):
            b = places[j][2]
            n = max(len(a), len(b))
            if find(i) != find(j) and n - min(len(a), len(b)) <= 0.2 * n and levenshtein(a, b) <= int(n * (1 - least) + 1e-9):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {(d, k) for i, (d, k, _) in enumerate(places) if find(i) != i}


def removed(df):
    keyed = df.withColumns({"_k1": df["doc_id"], "_k2": df["doc_id"]})
    return {(r["_k1"], k) for r in lines.removals(keyed).collect() for k in r["lines"]}


def test_one_word_edits_go(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(400)]
    texts = []
    for k in range(24):
        words = rnd.choices(vocabulary, k=rnd.randint(10, 40))
        other = list(words)
        other[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts += [" ".join(words), " ".join(rnd.choices(vocabulary, k=20)) + "\n" + " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    assert len(want) == 24 and removed(df) == want


def test_short_lines_take_part(spark):
    texts = ["All rights reserved.\nsome words of one", "other words of two\nall rights reserved", "ok\nmore", "ok\nnone of these 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert removed(df) == {(1, 1), (3, 0)}
