"""AVI motion-JPEG: reading clips with timed shots from media columns, and a lossless stored form of texts.

Reading (read_clips): RIFF chunks are walked to the frame index (idx1; without it, the movi list), frames are decoded (baseline
JPEG with any tables, one or three components, any sampling, restart intervals; without tables of their own the standard
ones, as cameras leave them out), and a shot begins where the histogram difference of neighbouring frames exceeds a threshold
adapted to the differences around. A row for each shot of a clip, with its times. What can't be read (truncated, hostile, of
another kind) is a row with an error, never a failed task. An empty frame repeats the one before.

Storing (clips): a payload of 8-bit samples lies in grey baseline frames of 16 x 12 blocks, a sample for each 8 x 8 block:
the block is flat, so its only coefficient is the DC one, quantised by 8, which is the sample less 128 exactly; any
baseline decoder gives 64 pixels of the sample's value. The DC Huffman table gives the category of c bits a code of 9 - c
bits, so that each difference takes 9 bits, and the end of block 1: ten bits a sample, whatever the samples, which whole
batches of frames encode and decode at once.

Null and empty texts are a payload of 192 blanks. Texts are stored whole. Equal texts give equal files. Null media: a row
with the error `no media`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcintel.llm.shared import ship
from srcintel.llm.text import as_bytes, enter, steps

WIDE, HIGH = 16, 12
FRAME = WIDE * HIGH
RATE = 25

_DQT = b"\xff\xdb\x00\x43\x00" + bytes([8] + [1] * 63)
_SOF = struct.pack(">BBHBHHBBBB", 0xFF, 0xC0, 11, 8, 8 * HIGH, 8 * WIDE, 1, 1, 0x11, 0)
_DC_CODES = [0] * 16
for _c in range(9):
    _DC_CODES[8 - _c] = 1  # category c has a code of 9 - c bits
_DHT_DC = bytes(_DC_CODES) + bytes(range(8, -1, -1))
_DHT_AC = bytes([1] + [0] * 15) + b"\x00"
_DHT = b"\xff\xc4" + struct.pack(">H", 2 + 1 + len(_DHT_DC) + 1 + len(_DHT_AC)) + b"\x00" + _DHT_DC + b"\x10" + _DHT_AC
_SOS = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
HEAD = b"\xff\xd8" + _DQT + _SOF + _DHT + _SOS
TAIL = b"\xff\xd9"


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """The 10 bits of each difference -255..255 (index + 255), and the difference of each 10 bits."""
    code = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = (1 << (8 - c)) - 1 << 1 if c < 9 else 0  # 8 - c ones and a zero
        extra = d if d >= 0 else d + (1 << c) - 1
        code[d + 255] = ((prefix << c) | extra) << 1
    back = np.full(1024, 10_000, np.int16)
    back[code] = np.arange(-255, 256)
    return code, back


_CODE, _DIFFERENCE = _code_table()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG for each row of 192 samples."""
    level = samples.astype(np.int16) - 128
    difference = level.copy()
    difference[:, 1:] -= level[:, :-1]
    code = _CODE[difference + 255].reshape(len(samples), -1, 4).astype(np.uint64)
    five = (code[..., 0] << np.uint64(30)) | (code[..., 1] << np.uint64(20)) | (code[..., 2] << np.uint64(10)) | code[..., 3]
    packed = five.astype(">u8").view(np.uint8).reshape(len(samples), -1, 8)[..., 3:].reshape(len(samples), -1)
    flat = packed.reshape(-1)
    marks = np.flatnonzero(flat == 0xFF)
    stuffed = np.insert(flat, marks + 1, 0).tobytes()
    width = packed.shape[1]
    end = (np.arange(1, len(samples) + 1) * width + np.searchsorted(marks, np.arange(1, len(samples) + 1) * width)).tolist()
    out, lo = [], 0
    for hi in end:
        out.append(HEAD + stuffed[lo:hi] + TAIL)
        lo = hi
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], rate: int = RATE) -> bytes:
    """A RIFF AVI file of one MJPG stream, with an index."""
    n, largest = len(frames), max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, n, 0, 1, largest, 8 * WIDE, 8 * HIGH, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I", 0, 0, 0, 1, rate, 0, n, largest, 0xFFFFFFFF, 0) + struct.pack("<4H", 0, 0, 8 * WIDE, 8 * HIGH)
    form = struct.pack("<IiiHH4sIiiII", 40, 8 * WIDE, 8 * HIGH, 1, 8, b"MJPG", 64 * FRAME, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    size = np.fromiter(map(len, frames), np.int64, n)
    at = 4 + np.cumsum(8 + size + (size & 1)) - (8 + size + (size & 1))
    index = np.empty((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, at, size
    movi = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", f) for f in frames]))
    body = b"AVI " + header + movi + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(raw: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, frames) of an AVI file, by its index where there is one. ValueError for what isn't whole."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index, at = float(RATE), None, None, 12
    while at + 8 <= len(raw):
        name, (size,) = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)
        kind = raw[at + 8 : at + 12]
        if name == b"LIST" and kind == b"hdrl":
            p = raw.find(b"avih", at, at + 8 + size)
            if p < 0 or p + 12 > len(raw):
                raise ValueError("no header")
            (micro,) = struct.unpack_from("<I", raw, p + 8)
            rate = 1e6 / micro if micro else rate
        elif name == b"LIST" and kind == b"movi":
            movi = (at + 8, min(size, len(raw) - at - 8))
        elif name == b"idx1":
            index = np.frombuffer(raw, "<u4", 4 * (min(size, len(raw) - at - 8) // 16), at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        found, p, stop = [], movi[0] + 4, movi[0] + movi[1]
        while p + 8 <= stop:
            (size,) = struct.unpack_from("<I", raw, p + 4)
            if raw[p : p + 4] == b"LIST":  # records of frames
                p += 12
                continue
            if raw[p + 2 : p + 4] in (b"dc", b"db"):
                if p + 8 + size > stop:
                    raise ValueError("a frame is cut off")
                found.append(raw[p + 8 : p + 8 + size])
            p += 8 + size + (size & 1)
        return rate, found
    kind = index[:, 0] >> 16
    video = index[(kind == int.from_bytes(b"dc", "little")) | (kind == int.from_bytes(b"db", "little"))].astype(np.int64)
    base = movi[0] + 8
    if len(video) and raw[int(video[0, 2]) : int(video[0, 2]) + 4] == int(video[0, 0]).to_bytes(4, "little"):
        base = 8  # places in the file, not in the list
    if len(video) and int((video[:, 2] + video[:, 3]).max()) + base > len(raw):
        raise ValueError("a frame is cut off")
    return rate, [raw[base + a : base + a + s] for a, s in zip(video[:, 2].tolist(), video[:, 3].tolist())]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The samples (DC images) of frames that encode_frames() made, len(frames) x 192, all at once."""
    flat = np.frombuffer(b"".join([f[len(HEAD) : -2] for f in frames]), np.uint8)
    stuffing = np.zeros(len(flat), bool)
    stuffing[1:] = (flat[:-1] == 0xFF) & (flat[1:] == 0)
    packed = flat[~stuffing].reshape(len(frames), -1, 5)
    wide = np.zeros((*packed.shape[:2], 8), np.uint8)
    wide[..., 3:] = packed
    five = wide.view(">u8")[..., 0].astype(np.uint64)
    code = np.stack([(five >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], -1).astype(np.int64)
    level = np.cumsum(_DIFFERENCE[code].reshape(len(frames), -1), axis=1, dtype=np.int32)
    return (level + 128).astype(np.uint8)


#: Pixels of a frame beyond which a file is an error: hostile headers claim billions.
MOST_PIXELS = 1 << 26
_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8)))
_COSINE = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _standard_tables() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The Huffman tables that ISO/IEC 10918-1, annex K, gives as typical."""
    dc = bytes(range(12))
    ac = [
        (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
        (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"),
    ]
    return {
        0x00: _table(bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), dc),
        0x01: _table(bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), dc),
        0x10: _table(ac[0][0], bytes.fromhex(ac[0][1])),
        0x11: _table(ac[1][0], bytes.fromhex(ac[1][1])),
    }


def _table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) of the code that each 16 bits begin with; length 0 for none."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    at = k = 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            size = 1 << (16 - bits)
            if at + size > 1 << 16 or k >= len(symbols):
                raise ValueError("bad Huffman table")
            length[at : at + size], symbol[at : at + size] = bits, symbols[k]
            at, k = at + size, k + 1
    return length, symbol


def _segments(data: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers, up to another marker."""
    parts, begun, p = [], 0, data.find(b"\xff")
    while 0 <= p < len(data) - 1:
        if data[p + 1] == 0:
            p += 2
        elif 0xD0 <= data[p + 1] <= 0xD7:
            parts.append(data[begun:p])
            begun = p = p + 2
        elif data[p + 1] == 0xFF:
            p += 1
        else:
            break
        p = data.find(b"\xff", p)
    parts.append(data[begun : p if 0 <= p < len(data) - 1 else len(data)])
    return [x.replace(b"\xff\x00", b"\xff") for x in parts]


def decode_frame(frame: bytes) -> np.ndarray:
    """The pixels of a baseline JPEG, height x width (grey) or height x width x 3 (RGB). ValueError for what isn't one."""
    try:
        return _decode(frame)
    except (IndexError, KeyError, struct.error, TypeError) as e:
        raise ValueError(f"broken frame ({type(e).__name__})") from None


def _decode(frame: bytes) -> np.ndarray:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, restart, parts, tables = 2, {}, 0, [], dict(_STANDARD)
    while True:
        while frame[at] != 0xFF or frame[at + 1] == 0xFF:
            at += 1
        marker = frame[at + 1]
        (size,) = struct.unpack_from(">H", frame, at + 2)
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if len(body) < size - 2:
            raise ValueError("a segment is cut off")
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, 1).astype(np.float64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if bits != 8 or n not in (1, 3) or not high or not wide or high * wide > MOST_PIXELS or not all(0 < h < 5 and 0 < v < 5 for _, h, v, _ in parts):
                raise ValueError("not a baseline frame of 8 bits, one or three components and a sane size")
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            (restart,) = struct.unpack_from(">H", body)
        elif marker == 0xDA:
            scan = {body[1 + 2 * k]: (tables[body[2 + 2 * k] >> 4], tables[0x10 | body[2 + 2 * k] & 15]) for k in range(body[0])}
            break
    if len(scan) != len(parts):
        raise ValueError("not one interleaved scan")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    planes = [np.zeros((down * v, across * h, 64)) for _, h, v, _ in parts]
    units, n = across * down, 0
    for data in _segments(frame[at:]):
        if n >= units:
            break
        bits, pos, last = int.from_bytes(data + b"\0\0\0\0", "big"), 0, [0] * len(parts)
        total = 8 * len(data) + 32

        def take(k: int) -> int:
            nonlocal pos
            pos += k
            if pos > total - 32:
                raise ValueError("the data ends early")
            return bits >> (total - pos) & ((1 << k) - 1)

        def symbol(table: tuple[np.ndarray, np.ndarray]) -> int:
            peek = bits >> (total - pos - 16) & 0xFFFF
            if not (k := int(table[0][peek])):
                raise ValueError("no such code")
            take(k)
            return int(table[1][peek])

        def value(k: int) -> int:
            x = take(k)
            return x if not k or x >> (k - 1) else x - (1 << k) + 1

        for _ in range(min(restart or units, units - n)):
            y, x = divmod(n, across)
            for c, (name, h, v, _) in enumerate(parts):
                dc, ac = scan[name]
                for block in range(h * v):
                    out = planes[c][y * v + block // h, x * h + block % h]
                    last[c] += value(symbol(dc) & 15)
                    out[0] = last[c]
                    k = 1
                    while k < 64:
                        code = symbol(ac)
                        if not code & 15 and code != 0xF0:
                            break
                        k += code >> 4
                        if code & 15:
                            out[k] = value(code & 15)
                        k += 1
            n += 1
    if n < units:
        raise ValueError("the data ends early")
    images = []
    for plane, (_, h, v, q) in zip(planes, parts):
        table = np.zeros((*plane.shape[:2], 64))
        table[..., _ZIGZAG] = plane * quant[q]
        pixels = np.einsum("ux,abuv,vy->axby", _COSINE, table.reshape(*plane.shape[:2], 8, 8), _COSINE, optimize=True).reshape(8 * plane.shape[0], -1) + 128
        images.append(np.repeat(np.repeat(pixels, most_v // v, 0), most_h // h, 1)[:high, :wide])
    if len(images) == 1:
        return np.clip(np.rint(images[0]), 0, 255).astype(np.uint8)
    y, cb, cr = images[0], images[1] - 128, images[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)), 0, 255).astype(np.uint8)


_STANDARD = _standard_tables()


def histogram(image: np.ndarray, bins: int = 32) -> np.ndarray:
    """Shares of the image's brightness in each bin."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    return np.bincount((grey.reshape(-1).astype(np.float64) * bins / 256).astype(np.int64), minlength=bins)[:bins] / max(1, grey.size)


def shots_of(raw: bytes) -> list[tuple[float, float, int]]:
    """(start, end, frames) of each shot of an AVI file. ValueError for what can't be read."""
    rate, frames = parse(raw)
    rows: list[np.ndarray] = []
    for f in frames:
        if f:
            rows.append(histogram(decode_frame(f)))
        elif rows:
            rows.append(rows[-1])
    if not rows:
        raise ValueError("no frames")
    change = np.zeros(len(rows))
    change[1:] = np.abs(np.diff(np.stack(rows), axis=0)).sum(1) / 2
    at = np.flatnonzero(cuts(change, np.array([0, len(rows)]))).tolist()
    return [(a / rate, b / rate, b - a) for a, b in zip(at, [*at[1:], len(rows)])]


def read_clips(media: DataFrame, column: str = "media", id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """id_columns, clip (from 0), start, end (seconds), frames, error: a row for each shot of each file; of a file that can't be read one row with the error."""
    ship(media.sparkSession)
    kinds = dict(media.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in id_columns), "clip int", "start double", "end double", "frames int", "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("mjpeg")
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column("media")[k].as_py()
                try:
                    rows = [(n, *shot, None) for n, shot in enumerate(shots_of(raw) if raw is not None else [])] or [(None, None, None, None, "no media")]
                except ValueError as e:
                    rows = [(None, None, None, None, str(e))]
                clip, start, end, frames, error = zip(*rows)
                own = [batch.column(c).take(pa.array([k] * len(rows))) for c in id_columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(clip, pa.int32()), pa.array(start, pa.float64()), pa.array(end, pa.float64()), pa.array(frames, pa.int32()), pa.array(error, pa.string())], [*id_columns, "clip", "start", "end", "frames", "error"])

    return media.select(*id_columns, F.col(column).alias("media")).mapInArrow(run, schema)


def differences(images: np.ndarray, first: np.ndarray, bins: int = 32) -> np.ndarray:
    """Histogram difference (0 to 1) of each frame to the one before; 0 at each file's first frame."""
    n = len(images)
    count = np.bincount((np.arange(n)[:, None] * bins + images // (256 // bins)).reshape(-1), minlength=n * bins).reshape(n, bins)
    out = np.zeros(n)
    out[1:] = np.abs(count[1:] - count[:-1]).sum(1) / (2 * images.shape[1])
    out[first] = 0
    return out


def cuts(difference: np.ndarray, ptr: np.ndarray, reach: int = 8, spread: float = 2.5, least: float = 0.15) -> np.ndarray:
    """True where a shot begins: at each file's first frame, and where a difference exceeds both `least` and the mean
    of those within `reach` frames of its file, itself left out, by `spread` standard deviations."""
    n = len(difference)
    total, square = np.concatenate([[0.0], np.cumsum(difference)]), np.concatenate([[0.0], np.cumsum(difference**2)])
    size = np.diff(ptr)
    lo = np.maximum(np.arange(n) - reach, np.repeat(ptr[:-1] + 1, size))
    hi = np.minimum(np.arange(n) + reach + 1, np.repeat(ptr[1:], size))
    lo = np.minimum(lo, hi)
    count = np.maximum(1, hi - lo - 1)
    mean = (total[hi] - total[lo] - difference) / count
    deviation = np.sqrt(np.maximum(0, (square[hi] - square[lo] - difference**2) / count - mean**2))
    out = difference > np.maximum(least, mean + spread * deviation)
    out[ptr[:-1]] = True
    return out


def payloads(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (frames x 192) of all texts, each text's range of frames, and its bytes before padding."""
    data, off = as_bytes(col)
    size = np.diff(off)
    frames = np.maximum(1, -(-size // FRAME))
    ptr = np.concatenate([[0], np.cumsum(frames)])
    out = np.full(int(ptr[-1]) * FRAME, 32, np.uint8)
    shift = np.repeat(ptr[:-1] * FRAME - off[:-1], size)
    out[np.arange(len(data)) + shift] = data
    return out.reshape(-1, FRAME), ptr, size


CLIPS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def clip_rows(docs: DataFrame) -> DataFrame:
    """doc_id, clip, start, end: a row for each shot of each document's stored form."""
    return clips(docs).select("doc_id", F.posexplode("shots").alias("clip", "shot")).select("doc_id", "clip", "shot.start", "shot.end")


def clips(docs: DataFrame, media: bool = False) -> DataFrame:
    """A row for each document: its stored form's digests, what is read back, and the clip's shots as `shots`
    (start and end seconds); media: with the AVI file itself."""
    ship(docs.sparkSession)
    schema = CLIPS + ", shots array<struct<start: double, end: double>>" + ", media binary" * media
    names = [c.split()[0] for c in CLIPS.split(", ")] + ["shots"] + ["media"] * media
    shot_type = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("mjpeg")
        for batch in steps(batches):
            samples, ptr, size = payloads(batch.column("text"))
            coded = encode_frames(samples)
            bounds = ptr.tolist()
            files = [avi(coded[a:b]) for a, b in zip(bounds, bounds[1:])]
            read = [parse(f) for f in files]
            images = decode_frames([x for _, frames in read for x in frames])
            raw = images.tobytes()
            begins = cuts(differences(images, ptr[:-1]), ptr)
            rows = []
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                payload = raw[a * FRAME : b * FRAME]
                rate = read[k][0]
                at = np.flatnonzero(begins[a:b]).tolist()
                shots = [{"start": s / rate, "end": e / rate} for s, e in zip(at, [*at[1:], b - a])]
                feature = f"frames={b - a};fps={rate:g};shots={len(at)};cuts=" + ",".join(str(s) for s in at[1:])
                rows.append((int(size[k]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(files[k]), hashlib.sha256(files[k]).hexdigest(), feature, shots, files[k]))
            cols = list(zip(*rows))
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in cols[:7]), pa.array(cols[7], shot_type)]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(cols[8], pa.binary())] * media], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
