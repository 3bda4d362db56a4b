"""The operators' parts against brute force, without Spark."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srcintel.llm import bpe, kneser_ney, langid, lines, mjpeg, neardup, packing, repair, repetition, toxicity
from srcintel.llm.bpe import ChunkEncoder, tokenizer_path
from srcintel.llm.text import BASE, HASHED, U, mix, range_hash, steps, unmix, words

TEXTS = st.lists(st.one_of(st.none(), st.text("ab é\t\n.X#|漢", max_size=40)), max_size=8)


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    w = words(pa.array(texts, pa.string()))
    got = [[bytes(w.data[w.start[k] : w.end[k]]).decode() for k in range(a, b)] for a, b in zip(w.ptr, w.ptr[1:])]
    assert got == [split(t) for t in texts]
    flat = [x for t in texts for x in split(t)]
    assert len(set(zip(flat, w.hash.tolist()))) == len(set(flat)) == len(set(w.hash.tolist()))


def test_mix_is_a_bijection():
    x = np.random.default_rng(1).integers(0, 2**63, 1000).astype(U)
    assert (unmix(mix(x)) == x).all()


def test_steps_keep_all_rows():
    b = pa.record_batch({"text": ["x" * k for k in (5, 0, 900, 3, 1)] + [None]})
    got = [x for s in steps(iter([b]), limit=10) for x in s.column("text").to_pylist()]
    assert got == b.column("text").to_pylist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abXÉ é́\t\n's<|endoftext|>.!?٣漢ςΣİ\x85\x1c0", max_size=30), max_size=5))
def test_chunks_encode_as_the_whole(texts):
    e = ChunkEncoder.at(tokenizer_path())
    ids, ptr = e.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("漢あ。！한\u3099\u0301a. ?", max_size=14), max_size=6))
def test_east_asian_stops_part_units(texts):
    e = ChunkEncoder.at(tokenizer_path())
    ids, ptr = e.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_sentences_end():
    e = ChunkEncoder.at(tokenizer_path())

    def ends(text):
        ids, ptr, stops = e.encode_closed(pa.array(["x y", text]), 1, marked=True)
        whole = e.tokenizer.encode(text, add_special_tokens=False)
        first = int(ptr[1])
        return [text[: whole.offsets[s - first - 1][1]] for s in stops.tolist() if s > first]

    assert ends("One. Two! three, v1.5 four?") == ["One.", "One. Two!", "One. Two! three, v1."]
    assert ends("你好。再见。好") == ["你好。", "你好。再见。"]
    assert ends("यह है। और") == ["यह है।"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("'strevlmdSRÉéß×-1 <|\x7f", max_size=14), max_size=6))
def test_contractions_and_pieces(texts):
    e = ChunkEncoder.at(tokenizer_path())
    ids, ptr = e.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=60), min_size=1, max_size=6))
def test_repair_round_trip(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    ptr = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    raw = repair.block_bytes(list(range(len(docs))), ids, ptr, 6, least=2)
    b = repair.Block(raw, 0)
    assert [b.doc(k).tolist() for k in range(len(docs))] == docs
    for k, d in enumerate(docs):
        for lo in range(0, len(d), 7):
            assert b.slice(k, lo, min(len(d), lo + 9)).tolist() == d[lo : lo + 9]
    assert all(int(b.lengths[k]) == len(repair.expand(np.array([6 + k]), b.rules, 6)) for k in range(len(b.rules)))


def test_repair_compresses():
    ids = np.tile(np.arange(50, dtype=np.uint32), 200)
    seq, rules, _ = repair.grammar(ids, np.zeros(len(ids), bool), 50)
    assert len(seq) < len(ids) / 8 and (repair.expand(seq, rules, 50) == ids).all()


def test_repair_goes_on_until_no_pair_is_frequent():
    rnd = np.random.default_rng(1)
    words = [rnd.integers(0, 90, rnd.integers(2, 300)) for _ in range(12)]
    docs = [words[k] for k in rnd.integers(0, 12, 400)]
    ids, ptr = np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    last = np.zeros(len(ids), bool)
    last[ptr[1:] - 1] = True
    seq, rules, ends = repair.grammar(ids, last, 100, least=8)
    pairs = np.stack([seq[:-1], seq[1:]], 1)[~ends[:-1]]
    left = np.unique(pairs, axis=0, return_counts=True)[1] if len(pairs) else np.zeros(0)
    assert not (left >= 8).any() and len(seq) < 500 and int(repair.expansion_lengths(rules, 100).max()) > 64
    lengths = repair.expansion_lengths(rules, 100)
    assert (repair.expand(seq, rules, 100) == ids).all() and (repair.expand_block(seq, rules, lengths, 100, len(ids)) == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80))
def test_blocks_expand_as_symbols_do(ids):
    seq, rules, _ = repair.grammar(np.array(ids, np.uint32), np.zeros(len(ids), bool), 5, least=2)
    assert repair.expand_block(seq, rules, repair.expansion_lengths(rules, 5), 5, len(ids)).tolist() == ids


def test_other_tokenizers_go_through_the_library(tmp_path):
    import json

    file = json.loads(open(tokenizer_path()).read())
    file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|[^\s\p{L}]+"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file))
    e = ChunkEncoder.at(str(path))
    texts = ["it's 1234 é", None, "", "a b"]
    ids, ptr = e.encode(pa.array(texts))
    assert not e.known and [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ChunkEncoder.at(tokenizer_path()).known


def test_table():
    from srcintel.llm.bpe import Table

    rnd = np.random.default_rng(3)
    keys = np.unique(rnd.integers(0, 2**63, 5000).astype(U) & ~U(0xFFFF) | U(7))  # many fall together
    t = Table(4)
    for lo in range(0, len(keys), 700):
        t.add(keys[lo : lo + 700])
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + U(1)) == -1).all()


def brute_cuts(at, cost, window):
    best = {0: 0}
    for j in range(1, len(at)):
        best[j] = min(best[i] + cost[j] + window - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= window)
    return best[len(at) - 1]


def test_packing_is_optimal():
    rnd = random.Random(2)
    for _ in range(50):
        at = np.cumsum([0] + [rnd.randrange(1, 6) for _ in range(25)])
        cost = np.array([rnd.choice([0, 2, 9]) for _ in at])
        ends = packing.best_cuts(at, cost, 12)
        pos = [0, *ends]
        total = sum(cost[j] + 12 - (at[j] - at[i]) for i, j in zip(pos, pos[1:]))
        assert ends[-1] == len(at) - 1 and total == brute_cuts(at.tolist(), cost.tolist(), 12)
    assert [packing.padded_length(n, 16) for n in (1, 2, 3, 8, 9, 16)] == [1, 2, 16, 8, 16, 16]


def naive_repeat(tokens, i):
    best = 0
    for j in range(len(tokens)):
        k = 0
        while i != j and max(i, j) + k < len(tokens) and tokens[i + k] == tokens[j + k]:
            k += 1
        best = max(best, k)
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), max_size=4))
def test_longest_repeats(docs):
    token = np.array([x + 10 * k for k, d in enumerate(docs) for x in d], np.int64)
    stop = np.repeat(np.cumsum([len(d) for d in docs]), [len(d) for d in docs]) if docs else np.zeros(0, np.int64)
    got = repetition.longest_repeats(token, stop).tolist()
    assert got == [naive_repeat(d, i) for d in docs for i in range(len(d))]


def test_repetition_counts():
    text = "a b c d é\na b c x\n \na b c x\n# *"
    f = repetition.features(words(pa.array([text, None])), 2)
    assert f["n_words"].tolist() == [15, 0] and f["word_chars"].tolist() == [15, 0] and f["n_symbols"].tolist() == [2, 0]
    assert f["n_repeat_words"].tolist() == [11, 0] and f["longest_repeat"].tolist() == [4, 0]
    assert repetition.repeated_lines(text) == 1 and repetition.repeated_lines(None) == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=192, max_size=192), min_size=1, max_size=3))
def test_frames_decode_exactly(rows):
    samples = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 192)
    frames = mjpeg.encode_frames(samples)
    rate, read = mjpeg.parse(mjpeg.avi(frames))
    assert rate == 25 and read == frames
    assert (mjpeg.decode_frames(read) == samples).all()
    image = mjpeg.decode_frame(frames[0])  # by the tables, bit after bit
    assert (image == np.kron(samples[0].reshape(12, 16), np.ones((8, 8), np.uint8))).all()
    raw = mjpeg.avi(frames)
    assert mjpeg.parse(raw[: raw.rindex(b"idx1")])[1] == frames  # without the index


def jpeg(planes, sampling, quant=3, restart=0, tables=True):
    """A baseline JPEG of planes of pixels (padded to whole units), with the standard codes, for tests only."""
    std = {0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12)))}
    length, symbol = mjpeg._STANDARD[0x10]
    codes = {}
    for kind, (size, sym) in {0x00: mjpeg._STANDARD[0x00], 0x10: (length, symbol)}.items():
        first = np.flatnonzero((size > 0) & np.append(True, (sym[1:] != sym[:-1]) | (size[1:] != size[:-1])))
        codes[kind] = {int(sym[k]): f"{k >> (16 - int(size[k])):0{int(size[k])}b}" for k in first}
    high, wide = planes[0].shape
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)

    def bits(value):
        k = abs(value).bit_length()
        return k, (f"{value if value > 0 else value + (1 << k) - 1:0{k}b}" if k else "")

    out, segments, last, want = "", [], [0] * len(planes), [np.zeros_like(p, float) for p in planes]
    units = [(y, x) for y in range(high // (8 * most_v)) for x in range(wide // (8 * most_h))]
    for n, (y, x) in enumerate(units):
        if restart and n and n % restart == 0:
            segments.append(out)
            out, last = "", [0] * len(planes)
        for c, (plane, (h, v)) in enumerate(zip(planes, sampling)):
            for b in range(h * v):
                r, q = 8 * (y * v + b // h), 8 * (x * h + b % h)
                f = mjpeg._COSINE @ (plane[r : r + 8, q : q + 8] - 128.0) @ mjpeg._COSINE.T
                z = np.rint(f / quant).astype(int)
                want[c][r : r + 8, q : q + 8] = mjpeg._COSINE.T @ (z * quant) @ mjpeg._COSINE + 128
                z = z.reshape(-1)[mjpeg._ZIGZAG].tolist()
                k, raw = bits(z[0] - last[c])
                last[c] = z[0]
                out += codes[0x00][k] + raw
                run = 0
                for value in z[1:]:
                    if value == 0:
                        run += 1
                        continue
                    while run > 15:
                        out, run = out + codes[0x10][0xF0], run - 16
                    k, raw = bits(value)
                    out, run = out + codes[0x10][run << 4 | k] + raw, 0
                if run:
                    out += codes[0x10][0]
    segments.append(out)
    data = b""
    for n, one in enumerate(segments):
        one += "1" * (-len(one) % 8)
        data += (b"" if n == 0 else bytes([0xFF, 0xD0 + (n - 1) % 8])) + bytes(int(one[k : k + 8], 2) for k in range(0, len(one), 8)).replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([quant] * 64) + b"\xff\xc0" + (8 + 3 * len(planes)).to_bytes(2, "big") + bytes([8]) + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([len(planes)])
    head += b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))
    if restart:
        head += b"\xff\xdd\x00\x04" + restart.to_bytes(2, "big")
    if tables:
        head += b"\xff\xc4" + (3 + 16 + 12).to_bytes(2, "big") + b"\x00" + bytes(std[0][0]) + bytes(std[0][1])
    head += b"\xff\xda" + (6 + 2 * len(planes)).to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([c + 1, 0]) for c in range(len(planes))) + b"\x00\x3f\x00"
    return head + data + b"\xff\xd9", want


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 2])
def test_frames_with_all_coefficients(sampling, restart):
    rnd = np.random.default_rng(5)
    h, v = sampling[0]
    planes = [np.clip(rnd.normal(128, 60, (32 * b // v, 48 * a // h)), 0, 255) for a, b in sampling]
    frame, want = jpeg(planes, sampling, restart=restart, tables=bool(restart))
    got = mjpeg.decode_frame(frame)
    up = [np.kron(w, np.ones((v // b, h // a))) for w, (a, b) in zip(want, sampling)]
    if len(up) == 3:
        y, cb, cr = up[0], up[1] - 128, up[2] - 128
        up = [np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)]
    assert got.shape == up[0].shape and np.abs(got - np.clip(up[0], 0, 255)).max() <= 0.51


def test_broken_media_is_told_apart():
    frames = mjpeg.encode_frames(np.random.default_rng(1).integers(0, 256, (4, 192)).astype(np.uint8))
    raw = mjpeg.avi(frames)
    assert [s[2] for s in mjpeg.shots_of(mjpeg.avi(frames[:1] * 3))] == [3]
    rnd = random.Random(2)
    for _ in range(200):
        bad = bytearray(raw)
        for _ in range(rnd.randrange(1, 6)):
            bad[rnd.randrange(len(bad))] = rnd.randrange(256)
        try:
            mjpeg.shots_of(bytes(bad[: rnd.randrange(len(bad))]) if rnd.random() < 0.5 else bytes(bad))
        except ValueError:
            continue
    with pytest.raises(ValueError):
        mjpeg.decode_frame(frames[0][:300])
    huge = frames[0].replace(mjpeg._SOF, mjpeg._SOF[:5] + b"\xff\xff\xff\xff" + mjpeg._SOF[9:])
    with pytest.raises(ValueError):
        mjpeg.decode_frame(huge)


def test_shots():
    images = np.repeat([[10] * 192, [200] * 192, [90] * 192], [6, 5, 7], axis=0).astype(np.uint8)
    begins = mjpeg.cuts(mjpeg.differences(images, np.array([0])), np.array([0, 18]))
    assert np.flatnonzero(begins).tolist() == [0, 6, 11]
    with pytest.raises(ValueError):
        mjpeg.parse(b"RIFFxxxxWAVE")


def test_probminhash_estimates():
    rnd = np.random.default_rng(4)
    a = mix(np.arange(1000, dtype=U))
    shingle = np.concatenate([a[:900], a[100:]])
    weight = rnd.integers(1, 4, 1000)
    both = np.concatenate([weight[:900], weight[100:]])
    got = neardup.probminhash(np.repeat([0, 1], 900), shingle, both, 2, 1024)
    x, y = (np.sort(a[:900]), weight[:900][np.argsort(a[:900])]), (np.sort(a[100:]), weight[100:][np.argsort(a[100:])])
    assert abs((got[0] == got[1]).mean() - neardup.similarity(x, y)) < 0.06


def test_similarity_against_the_sum():
    rnd = random.Random(6)
    for _ in range(40):
        sets = []
        for _ in range(2):
            keys = sorted(rnd.sample(range(12), rnd.randrange(1, 9)))
            sets.append((np.array(keys), np.array([rnd.randrange(1, 5) for _ in keys])))
        x, y = (dict(zip(s[0].tolist(), s[1].tolist())) for s in sets)
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        assert abs(neardup.similarity(*sets) - want) < 1e-9


def test_shingles_of_short_texts():
    w = words(pa.array(["a b c d e f", "a b", "", None, "a b c d e"]))
    s, off = neardup.shingles(w.hash, w.ptr, 5)
    assert np.diff(off).tolist() == [2, 1, 0, 0, 1] and s[0] == s[3]


def test_viterbi_against_brute_force():
    import itertools

    rnd = np.random.default_rng(7)
    score = rnd.normal(size=(12, 3)).astype(np.float32)
    ptr = np.array([0, 5, 5, 6, 12])
    got = langid.viterbi(score, ptr, 0.7)
    for a, b in zip(ptr, ptr[1:]):
        def value(path):
            return sum(score[a + k, s] for k, s in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:]))

        if b > a:
            best = max(itertools.product(range(3), repeat=int(b - a)), key=value)
            assert abs(value(got[a:b].tolist()) - value(best)) < 1e-5


def pieces(text):
    shown, off, start, end, ptr, script, has = langid.split(pa.array([text], pa.string()))
    raw = (text or "").encode()
    return [(raw[a:b].decode(), langid.SCRIPTS[k]) for a, b, k in zip(start, end, script)]


def test_words_end_where_scripts_change():
    assert pieces("hello世界 ok") == [("hello", "latin"), ("世界", "han"), ("ok", "latin")]
    assert pieces("\u201cquoted\u201d, ế ქართული") == [("quoted", "latin"), ("ế", "latin"), ("ქართული", "georgian")]
    assert pieces("e\u0301te\u0301 12 ж1λ") == [("e\u0301te\u0301", "latin"), ("ж", "cyrillic"), ("λ", "greek")]
    assert pieces("日本語です。한국어") == [("日本", "han"), ("語", "han"), ("です", "kana"), ("한국어", "hangul")]
    assert pieces("\u0301a") == [("a", "latin")] and pieces(None) == pieces("") == pieces("1 ! \U0001f600") == []
    assert [p[1] for p in pieces("a é ж λ 漢 あ 한 ع क ไ")] == ["latin", "latin", "cyrillic", "greek", "han", "kana", "hangul", "arabic", "devanagari", "thai"]
    assert langid.split(pa.array(["a", "1 2", "", None, "漢", "٣"]))[6].tolist() == [True, False, False, False, True, False]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aÉ 1.漢字あж\u0301e😀\u200b", max_size=12), max_size=5))
def test_words_against_characters(texts):
    shown, off, start, end, ptr, script, has = langid.split(pa.array(texts, pa.string()))
    raw = "".join(texts).encode()
    for k, text in enumerate(texts):
        want, now, kind = [], "", None
        for c in text:
            code = langid._SCRIPT[ord(c)]
            if code == langid._MARK and now:
                now += c
                continue
            full = kind in map(langid.SCRIPTS.index, langid.UNSPACED) and sum(langid._SCRIPT[ord(x)] != langid._MARK for x in now) == langid.PIECE
            if code >= langid._MARK or code != kind or full:
                want += [now] * bool(now)
                now, kind = ("", None) if code >= langid._MARK else (c, code)
            else:
                now += c
        want += [now] * bool(now)
        assert [raw[a:b].decode() for a, b in zip(start[ptr[k] : ptr[k + 1]], end[ptr[k] : ptr[k + 1]])] == want
        assert has[k] == any(c.isalpha() for c in text)


def test_normal_lines():
    x = lines.Lines(pa.array(["HÉllo, wörld!\n\n-- **\nhéllo   WÖRLD «x» 3", None, "", "héllo wörld x 3", "漢字\n12", "ab"]), 3)
    assert [x.text_of(k) for k in range(len(x.key))] == ["héllo wörld", "héllo wörld x 3", "héllo wörld x 3"]
    assert x.text.tolist() == [0, 0, 3] and x.number.tolist() == [0, 3, 0] and x.key[1] == x.key[2] != x.key[0]
    y = lines.Lines(pa.array(["漢字\n12", "ab"]), 2)  # characters, not bytes
    assert [y.text_of(k) for k in range(3)] == ["漢字", "12", "ab"] and len(lines.Lines(pa.array(["漢字\n12"]), 3).key) == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distances():
    rnd = random.Random(3)
    pairs = []
    for k in range(500):
        n = rnd.choice([3, 12, 63, 64, 65, 140, 200])
        a = "".join(rnd.choices("abc é漢", k=rnd.randint(0, n)))
        b = list(a) if k % 3 else rnd.choices("abc é", k=rnd.randint(0, n))
        for _ in range(rnd.randint(0, n // 4)):
            if b:
                b[rnd.randrange(len(b))] = rnd.choice(["x", "", "yy"])
        pairs.append((a, "".join(b)))
    want = [levenshtein(a, b) for a, b in pairs]
    assert lines.distances(pairs) == want
    assert lines.edit_similar(pairs, 0.8) == [d <= int(max(len(a), len(b)) * 0.2 + 1e-9) for d, (a, b) in zip(want, pairs)]
    for d, (a, b) in zip(want, pairs):
        most = rnd.randint(0, 60)
        got = lines.distance(a, b, most)
        assert (got == d if d <= most else got > most) and (lines._bound(a, b, 999) >= d)


def test_promises_leave_out_lines_that_only_share_a_passage():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    passage = text(50)
    shared = [f"{text(rnd.randint(20, 30))} {passage} {text(rnd.randint(20, 30))}" for _ in range(30)]
    edited = []
    for _ in range(30):
        line = text(80).split(" ")
        other = list(line)
        for k in rnd.sample(range(80), 10):
            other[k] = rnd.choice(words)
        edited += [" ".join(line), " ".join(other)]
    s = np.frombuffer(b"".join(lines.sketches(shared + edited)), np.uint8).reshape(len(shared) + len(edited), -1)
    assert sum(int((lines.promise(np.broadcast_to(s[i], s[i + 1 : 30].shape), s[i + 1 : 30], 0.8) >= lines.PROMISE).sum()) for i in range(29)) < 0.05 * 435
    square = lines.promises_of_all(s, 0.8)
    assert all(np.allclose(square[i], lines.promise(np.broadcast_to(s[i], s.shape), s, 0.8)) for i in range(len(s)))
    assert sum(lines.promise(s[k : k + 1], s[k + 1 : k + 2], 0.8)[0] >= lines.PROMISE for k in range(30, 90, 2)) >= 29


def partition(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [x if r == y else r for r in root]
    return {frozenset(k for k in range(n) if root[k] == r) for r in root}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 22), min_size=1, max_size=4), st.randoms(use_true_random=False))
def test_spanning_forests_are_those_of_the_whole_graph(sizes, rnd):
    from srcintel.llm import links

    cuts = np.cumsum([0, *sizes]).tolist()
    n = cuts[-1]
    true = {(i, j) for lo, hi in zip(cuts, cuts[1:]) for i in range(lo, hi) for j in range(i + 1, hi) if rnd.random() < 0.3}
    tried = []

    def similar(pairs):
        tried.extend(pairs)
        return [p in true for p in pairs]

    got = list(links.spanning(cuts, lambda i, j: np.array([rnd.random() for _ in i]), lambda lo, hi: np.array([[rnd.random() for _ in range(lo, hi)] for _ in range(lo, hi)]), 0.0, similar))
    assert partition(n, got) == partition(n, true) and set(got) <= true and len(tried) == len(set(tried))
    assert len(got) == n - len(partition(n, true))


def test_discounts():
    d = kneser_ney.discounts(np.array([0, 10, 5, 3, 2]))
    y = 10 / 20
    assert d[1:].tolist() == pytest.approx([1 - 2 * y * 5 / 10, 2 - 3 * y * 3 / 5, 3 - 4 * y * 2 / 3])
    assert kneser_ney.discounts(np.zeros(5)).tolist() == [0] * 4


def test_counts_pack():
    n = np.array([0, 1, 254, 255, 256, 10**12])
    assert (kneser_ney._unpack(kneser_ney._pack(n), len(n)) == n).all()


def test_chain_uses_out_of_fold_predictions():
    rnd = np.random.default_rng(8)
    n = 400
    texts = [" ".join(rnd.choice(["p", "q", "r", "s"], 8)) + (" bad" if k % 4 == 0 else "") + (" vile" if k % 8 == 0 else "") for k in range(n)]
    word, off, dense = toxicity.extract(pa.array(texts))
    row = np.repeat(np.arange(n), np.diff(off))
    labels = np.stack([np.arange(n) % 4 == 0, np.arange(n) % 8 == 0], 1).astype(float)
    chain = toxicity.fit_chain(word, row, dense, labels, np.arange(n) % 5, 5, 3e-4, 3, 100)
    earlier = []
    for k, (chosen, w) in enumerate(chain):
        assert len(w) == len(chosen) + dense.shape[1] + k + 1
        p = toxicity._sigmoid(toxicity.Rows(*toxicity._columns(chosen, word, row), len(chosen), toxicity._with(dense, earlier)).times(w))
        earlier.append(p)
        assert ((p > 0.5) == (labels[:, k] > 0)).mean() > 0.98


def test_crc_of_ids():
    from srcintel.llm.text import id_crc

    assert id_crc(pa.array([12, None])).tolist() == [zlib.crc32(b"12"), 0]


def test_many_distances_in_a_band():
    rnd = random.Random(11)
    pairs = []
    for k in range(400):
        a = "".join(rnd.choices("abcdé fg", k=rnd.choice([3, 40, 64, 65, 128, 200])))
        b = list(a)
        for _ in range(rnd.randint(0, len(a) // 3 + 1)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 1)] = rnd.choice(["", "漢", "a", "bc"])
        if k % 3 == 0:
            b = list("".join(rnd.choices("abcd", k=len(a) // 5))) + b[: len(b) - len(a) // 9]
        pairs.append((a, "".join(b)))
    want = lines.distances(pairs)
    for more in (-1, 0, 3):
        most = [max(0, d + more) for d in want]
        assert lines.within(pairs, most) == [d <= m for d, m in zip(want, most)]
    passage = "".join(rnd.choices("abcdefgh ", k=300))  # lines that only share a passage
    family = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(10, 120))) + passage + "".join(rnd.choices("abcdefgh ", k=rnd.randint(10, 60))) for _ in range(30)]
    pairs = [(a, b) for a in family for b in family if a < b]
    most = [int(0.2 * max(len(a), len(b))) for a, b in pairs]
    assert lines.within(pairs, most) == [d <= m for d, m in zip(lines.distances(pairs), most)]
    few = [(chr(0x4E00 + k) * 70, chr(0x4E00 + k) * 60 + "x" * 12) for k in range(200)]  # a letter of its own in each
    assert lines.within(few, [12] * 200) == [True] * 200 and lines.within(few, [11] * 200) == [False] * 200


def test_promises_of_two_chunks():
    rnd = random.Random(2)
    forms = [" ".join(rnd.choices(["lorem", "ipsum", "dolor", "sit", "amet"], k=rnd.randint(3, 30))) for _ in range(40)]
    s = np.frombuffer(b"".join(lines.sketches(forms)), np.uint8).reshape(40, -1)
    assert np.array_equal(lines.promises_of_all(s[:15], 0.8, s[15:]), lines.promises_of_all(s, 0.8)[:15, 15:])


def test_cells_of_two_sides_try_only_pairs_across():
    from srcintel.llm import links

    for n in (8, 40):  # a small cell, and one of which all promises are taken at once
        sides, tried = np.array([0] * (n // 2) + [1] * (n // 2) + [5] * n), []

        def similar(pairs):
            tried.extend(pairs)
            return [False] * len(pairs)

        ones = lambda lo, hi: np.ones((hi - lo, hi - lo))
        assert not list(links.spanning([0, n, 2 * n], lambda i, j: np.ones(len(i)), ones, 0.5, similar, None, sides, lambda lo, at, hi: np.ones((at - lo, hi - at))))
        assert sorted(tried) == [(i, j) for i in range(2 * n) for j in range(i + 1, 2 * n) if (i < n // 2 <= j < n) or n <= i]


def test_least_nodes_of_components():
    from srcintel.llm import links

    rnd = random.Random(4)
    for n in (1, 50, 400):
        some = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n * 4 // 5)] + [(k, k + 1) for k in range(n // 2)]
        label = {}
        for part in range(n):  # by search from each node not yet seen
            if part not in label:
                label[part], stack = part, [part]
                while stack:
                    x = stack.pop()
                    for u, v in some:
                        for a, b in ((u, v), (v, u)):
                            if a == x and b not in label:
                                label[b] = part
                                stack.append(b)
        assert links._roots(*(np.array([p[k] for p in some], np.int64) for k in (0, 1)), n).tolist() == [label[k] for k in range(n)]


def test_trees_of_cells_where_most_pairs_promise():
    from srcintel.llm import links

    rnd = random.Random(6)
    for n, share in ((3, 1.0), (30, 0.5), (300, 0.9), (300, 0.04)):
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if (i < n // 2) == (j < n // 2) and rnd.random() < share]  # two halves that nothing connects
        rnd.shuffle(pairs)
        known, asked = [k - k % 2 if k < 8 else k for k in range(n)], []  # some are connected from the start

        def find(k):
            asked.append(k)
            return known[k]

        label, want = list(known), []
        for i, j in pairs:
            if label[i] != label[j]:
                want.append((i, j))
                label = [label[i] if x == label[j] else x for x in label]
        cell = links._Cell(*(np.array([p[k] for p in pairs], np.int64) for k in (0, 1)))
        assert cell.take(find) == want
        rest = set(want)
        assert list(zip(cell.a.tolist(), cell.b.tolist())) == [p for p in pairs if p not in rest and known[p[0]] != known[p[1]]] or len(pairs) <= 64
        assert len(asked) < 2 * links.STRETCH + 3 * n  # not for each of 20,000 pairs


def test_only_pairs_that_agree_are_put_in_the_order_of_their_lines(monkeypatch):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(900)]
    forms = [" ".join(rnd.choices(words, k=40)) for _ in range(60)]
    forms += [form + " " + rnd.choice(words) for form in forms[:10]]
    s = np.frombuffer(b"".join(lines.sketches(forms)), np.uint8).reshape(70, -1)
    i, j = np.triu_indices(70, 1)
    want, square, cross = lines.promise(s[i], s[j], 0.8), lines.promises_of_all(s, 0.8), lines.promises_of_all(s[:30], 0.8, s[30:])
    foreign, rows = lines._foreign, []
    monkeypatch.setattr(lines, "_foreign", lambda same: rows.append(len(same)) or foreign(same))
    for every, some in ((want, lines.promise(s[i], s[j], 0.8, lines.PROMISE)), (square, lines.promises_of_all(s, 0.8, enough=lines.PROMISE)), (cross, lines.promises_of_all(s[:30], 0.8, s[30:], lines.PROMISE))):
        assert np.array_equal(some, np.where(every >= lines.PROMISE, every, -1.0)) and (some >= lines.PROMISE).any()
    assert sum(rows) < 0.1 * 70 * 70


def test_forests_of_cells_with_few_near_rows_take_few_calls():
    from srcintel.llm import links

    rnd, calls = np.random.default_rng(8), []

    def near(one, many):
        calls.append(len(many))
        return np.abs(np.broadcast_to(one, many.shape) - many).max(1) <= 1

    def least(rows, pairs):
        label = list(range(rows))
        for i, j in pairs:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        return label

    for rows, wide in ((1, 5), (2, 1), (40, 30), (90, 4), (200, 200), (200, 25)):
        signature = rnd.integers(0, wide, (rows, 2))
        calls.clear()
        found = list(links.forest(signature, near))
        assert len(calls) <= rows // 4 + 2
        want = [(i, j) for i in range(rows) for j in range(i) if np.abs(signature[i] - signature[j]).max() <= 1]
        assert set(found) <= {p for i, j in want for p in ((i, j), (j, i))}
        label = least(rows, want)
        assert least(rows, found) == label and len(found) == rows - len(set(label))


def peak_mb(run):
    """What run() returns, and the most MB of Python and numpy that it holds at once."""
    import tracemalloc

    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def prose(n_bytes, seed=1):
    """Texts of together about so many bytes, of words that come again and again, as a step of a worker has them."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé", k=rnd.randint(2, 9))) for _ in range(3000)]
    out, size = [], 0
    while size < n_bytes:
        out.append(" ".join(rnd.choices(vocabulary, k=300)) + rnd.choice(["", ".", "\n"]))
        size += len(out[-1].encode())
    return out


def test_range_hashes_beyond_one_block():
    data = np.random.default_rng(4).integers(0, 256, 3 * HASHED + 5, dtype=np.uint8)
    ranges = [(0, 9), (HASHED - 3, HASHED + 3), (HASHED, HASHED), (2 * HASHED, 3 * HASHED + 5), (len(data), len(data)), (5, 5 + 2 * HASHED)]
    got = range_hash(data, np.array([a for a, _ in ranges]), np.array([b for _, b in ranges]))
    value = [0]
    for a, b in ranges:
        total = 0
        for x in data[a:b][::-1].tolist():
            total = (total * BASE + x + 1) % 2**64
        value.append(total)
    assert got.tolist() == mix(np.array(value[1:], U)).tolist()


def test_range_hashes_take_one_word_a_byte():
    data = np.zeros(4 << 20, np.uint8)
    at = np.arange(0, len(data), 64)
    assert peak_mb(lambda: range_hash(data, at, at + 5))[1] < 12 * len(data) / 1e6


def test_encoding_takes_little_memory():
    """Of a step of 4 MB, as packing and Re-Pair take them: two workers of an executor pack beside a JVM that the stages before have grown."""
    col = pa.array(prose(4 << 20), pa.string())
    e = ChunkEncoder.at(tokenizer_path())
    e.encode(col)
    assert peak_mb(lambda: e.encode_closed(col, 1, marked=True))[1] < 50


@pytest.mark.parametrize("part", [1, 50, 4000])
def test_parts_encode_as_the_whole(monkeypatch, part):
    texts = [None, "", "One. Two!", ".", "\u0300", " ", "ab. ", None, *prose(9000, 3), "你好。再见。", ""]
    e = ChunkEncoder.at(tokenizer_path())
    whole = e.encode_closed(pa.chunked_array([pa.array(texts[:3]), pa.array(texts[3:])]), 1, marked=True)
    monkeypatch.setattr(bpe, "PART", part)
    parts = e.encode_closed(pa.array(texts), 1, marked=True)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_language_labels_take_little_memory():
    """Of a step of 6 MB."""
    col = pa.array(prose(6 << 20), pa.string())
    logs = np.random.default_rng(2).random((langid.SLOTS, 4)).astype(np.float32)
    assert peak_mb(lambda: langid.label_words(col, logs, np.ones((len(langid.SCRIPTS), 4), bool), 12.0))[1] < 110


def test_a_texts_word_scores_dont_depend_on_its_neighbours():
    logs = np.random.default_rng(2).random((langid.SLOTS, 3)).astype(np.float32)
    allowed = np.ones((len(langid.SCRIPTS), 3), bool)
    texts = ["ab cd", "ef", None, "g", "1", "hé", "漢字あ", "z"]
    alone = [langid.word_scores(pa.array([t], pa.string()), logs, allowed)[0].tolist() for t in texts]
    together, ptr = langid.word_scores(pa.array(texts, pa.string()), logs, allowed)[:2]
    assert [together[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == alone
