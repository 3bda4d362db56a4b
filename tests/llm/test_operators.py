"""The operators on small tables with nulls, empty and long texts, copies, ties, repeated rows, extra columns and no rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from srcintel.llm import kneser_ney, langid, lines, mixing, mjpeg, neardup, packing, queries, repair, repetition, toxicity
from srcintel.llm.bpe import ChunkEncoder, tokenizer_path

LONG = " ".join(f"w{k % 977}x{k}" for k in range(9000))
BASE = " ".join(f"tok{k} und" for k in range(60))
NEAR = BASE.replace("tok7 ", "changed ")
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, NEAR, "en", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \n\t ", "de", "b"),
    (None, "the cat and the dog " * 4, "en", None),
    (7, "der hund und die katze " * 4, "de", "a"),
    (8, LONG, "en", "c"),
    (9, "one line that is shared by two\nother words here and there", "en", "c"),
    (10, "One LINE, that is shared by two!\nmore different words in this", "en", "c"),
    (11, "repeat me " * 60, "en", "a"),
    (11, "repeat me " * 60, "en", "a"),
    (12, "漢字 123 ###", "de", "a"),
    (13, "12 34", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, key string, size int, part string, line string, path string, `odd name` int, lines int, n int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", 1, "p", "l", "q", 5, 6, 7) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.where("false")


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def test_kneser_ney(docs, empty):
    got = kneser_ney.train_and_score(docs, docs.where("doc_id % 3 != 0 or doc_id is null")).collect()
    assert len(got) == len(ROWS) and all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 6)} == {1}
    assert kneser_ney.train_and_score(empty, docs).count() == 0
    unknown = kneser_ney.train_and_score(docs, empty).where("doc_id = 1").first()
    assert unknown["n_known"] == 0 and unknown["score"] == 0 and unknown["train_tokens"] == 0


def test_lines(docs, empty):
    got = {(r["doc_id"], r["n_removed"], r["text"]) for r in lines.cleaned(docs).collect()}
    assert (10, 1, "more different words in this") in got and (9, 0, ROWS[9][1]) in got
    assert (2, 1, "") in got and (4, 0, None) in got and (5, 0, "") in got
    assert lines.cleaned(docs).columns == docs.columns + ["n_lines", "n_removed"]
    kept = lines.dedup(docs)
    # document 3's one line is document 1's with a word changed
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in ROWS} - {2, 3} and kept.columns == docs.columns
    assert lines.cleaned(empty).count() == 0


def test_neardup(docs, empty):
    got = neardup.classes(docs)
    rows = got.select("doc_id", "class_id", "class_size", "keep").collect()
    assert len(rows) == len(ROWS)
    size = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows}
    assert size[1] == size[2] == size[3] == (1, 3) and size[11] == (11, 2) and size[4] == (4, 1) and size[None] == (None, 1)
    assert sorted(r["doc_id"] for r in rows if r["keep"] and r["doc_id"] in (1, 2, 3)) == [1]
    assert neardup.classes(empty).count() == 0


def test_neardup_splits_large_groups(spark, monkeypatch):
    from srcintel.llm import links

    monkeypatch.setattr(links, "CELL", 3)
    texts = [(k, BASE.replace(f"tok{k} ", "x ")) for k in range(10)] + [(99, BASE)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["class_id"] for r in neardup.classes(df).collect()} == {0}
    assert {r["class_id"] for r in neardup.classes(df, cell=2).collect()} == {0}


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    import random

    from srcintel.llm import links

    rnd = random.Random(2)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)] + [(-5, 100)]
    df = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long")
    one = {tuple(r) for r in links.components(df).collect()}
    monkeypatch.setattr(links, "LOCAL", 3)
    assert {tuple(r) for r in links.components(df).collect()} == one and (-5, -5) in one and (120, -5) in one


def test_large_components_are_compared_across(spark):
    """Two kinds of items whose promises make one component; true links only inside a kind, and one item that only one other is like."""
    from srcintel.llm import links

    n = 60
    promised = spark.createDataFrame([(k, 0) for k in range(n)], "node long, root long")
    rows = [(k, k % 2 if k != 59 else 7, (k * 37) % n) for k in range(n)]
    contents = spark.createDataFrame(rows, "key long, kind long, place long")

    def verified(cell, cuts, parts):
        kind, key = cell.column("kind").to_pylist(), cell.column("key").to_pylist()
        similar = lambda pairs: [kind[i] == kind[j] and abs(key[i] - key[j]) < 40 or {key[i], key[j]} == {59, 4} for i, j in pairs]
        return links.spanning(cuts, lambda i, j: np.ones(len(i)), lambda lo, hi: np.ones((hi - lo, hi - lo)), 0.5, similar, parts)

    from pyspark.sql import functions as F

    for cell in (4, 100):
        got = {r["node"]: r["root"] for r in links.verified(promised, contents, verified, [F.col("place"), F.col("place") % 7], cell).collect()}
        assert got == {k: 0 if k % 2 == 0 or k == 59 else 1 for k in range(n)}, cell


def test_every_two_items_apart_meet_once(spark):
    from srcintel.llm import links

    items = [(k, 0, k if k < 60 else 60) for k in range(90)]  # sixty alone, thirty connected
    got = links._across(spark.createDataFrame(items, "key long, root long, label long"), 8).collect()
    runs = {}
    for r in got:
        runs.setdefault(r["run"], []).append(r)
    met = [tuple(sorted((a["key"], b["key"]))) for rows in runs.values() for n, a in enumerate(rows) for b in rows[:n] if len({r["side"] for r in rows}) == 1 or a["side"] != b["side"]]
    assert len(met) == len(set(met)) and {(a, b) for a in range(90) for b in range(a + 1, 90) if a < 60} == set(met)


def test_mjpeg(docs, empty):
    for r in mjpeg.clips(docs, media=True).collect():
        frames = mjpeg.decode_frames(mjpeg.parse(r["media"])[1]).tobytes()
        raw = {x[0]: x[1] for x in ROWS}[r["doc_id"]]
        raw = (raw or "").encode()
        assert frames == raw.ljust(-(-max(1, len(raw)) // 192) * 192) and r["payload_sha256"] == hashlib.sha256(frames).hexdigest()
        assert r["media_bytes"] == len(r["media"]) and r["n_bytes"] == len(raw) and r["tail_crc32"] == zlib.crc32(frames[-16:]) and r["shots"]
    assert mjpeg.clips(empty).count() == 0


def test_repetition(docs, empty):
    got = {r["doc_id"]: r for r in repetition.score(docs).collect()}
    assert got[11]["base_failed"] and not got[11]["kept"] and got[8]["kept"] and got[1]["kept"] and got[4]["base_failed"]
    assert repetition.score(empty).count() == 0


def encoded(text):
    return ChunkEncoder.at(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_packing(docs, empty):
    rows = packing.pack(docs.coalesce(1)).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:k]) for k in range(len(s))] and sum(r["length"] for r in s) <= 2048
    one = sorted((r for r in rows if r["doc_id"] == 8), key=lambda r: r["start"])
    ids = np.array(encoded(LONG), np.uint32)
    assert sum(r["length"] for r in one) == len(ids) == one[0]["doc_tokens"]
    for r in one:
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert packing.pack(empty).count() == 0


def test_repair(docs, empty):
    rows = sorted(repair.encode(docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    texts = {r[0]: r[1] for r in ROWS}
    at = 0
    for r in rows:
        ids = np.array(encoded(texts[r["doc_id"]]), np.uint32)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert repair.encode(empty).count() == 0


def test_toxicity(spark, empty):
    rows = [(k, f"word{k % 50} again {'you idiot' if k % 5 == 0 else 'fine'} word{k % 31}") for k in range(300)] + [(900, "such an idiot"), (901, "a fine day"), (902, None), (903, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 5 == 0)) for k in range(300)] + [(None, 1, 1), (5000, 1, 1), (901, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(d, labels).collect()}
    assert len(got) == len(rows) and got[900]["toxic"] and not got[901]["toxic"] and not got[902]["toxic"] and got[903]["p_toxic"] == 0
    assert all(got[k]["toxic"] == (k % 5 == 0) for k in range(300))
    assert toxicity.detect(d, labels.where("false")).where("toxic").count() == 0 and toxicity.detect(empty, labels).count() == 0


def capped(sizes, weights, most):
    """The contract's loop: what is above its cap stops there, the excess is reshared by weight."""
    total, fixed = float(sum(sizes)), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        left = total - sum(fixed.values())
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            return [fixed.get(k, share.get(k)) for k in range(len(sizes))]
        fixed.update({k: most * sizes[k] for k in over})


def test_mixing(spark, docs, empty):
    rows = [(k, "w " * (1 + k * 7 % 40), f"s{k % 4}" if k % 9 else "big") for k in range(900)] + [(1000, "x", "tiny"), (1001, None, None), (1002, "y z", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(d.repartition(5)).collect())) and len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    order = sorted(by, key=lambda s: (s is None, s))
    want = capped([by[s][0] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 3)
    for s, t in zip(order, want):
        assert abs(by[s][2] - t) < 1e-6 * max(1, t) and abs(by[s][1] - t) <= 40
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs).count() == len(ROWS)


def test_langid(docs, empty):
    got = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text"), docs).collect()}
    assert got[7]["lang_pred"] == "de" and got[None]["lang_pred"] == "en"
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (4, 5, 6, 13)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"} and langid.identify(empty, docs).count() == 0
    mixed = docs.sparkSession.createDataFrame([(1, "the cat and the dog the cat and the dog der hund und die katze der hund und die katze")], "doc_id long, text string")
    spans = langid.identify(mixed, docs.where("doc_id = 7 or doc_id is null"), spans=True, penalty=3.0).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"]


def test_pipeline(spark, docs):
    import corpus_pipeline

    now = docs
    n = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "").cache()
        n[name] = now.count()
        assert name == "pack" or now.columns == docs.columns
    # documents 2 and 3 lose their one line, and document 10 the line that it shares with document 9
    assert n["language_id"] == len(ROWS) - 4 and n["line_dedup"] == n["language_id"] - 2
    assert n["minhash_near_dedup"] < n["line_dedup"] and n["pack"] > 0


def test_queries_are_registered():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES} == set(range(1, 11))
