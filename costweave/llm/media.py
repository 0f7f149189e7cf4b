"""Media columns: AVI motion-JPEG.

Texts are stored as AVI files of baseline JPEG frames whose quantised coefficients are the payload: a block of 64
bytes is an 8 x 8 block in zigzag order (its unit; bytes below 128 are coefficients -128 to -1, others 1 to 128), so
storage is lossless although the pixels are an inverse transform. Each block is a restart interval. Reading parses the
RIFF tree, checks the index against the chunks, decodes the intra frames (Huffman codes of all restart intervals of
many frames in step, in numpy; dequantisation; an exact integer inverse DCT), compares luma histograms of neighbouring
frames and starts a new clip where a difference stands out from those just before.

Files are read whatever their tables, sampling factors and restart intervals, if the frames are baseline and carry
their tables. Null and empty texts are one block of zero bytes. Long texts are coded and decoded PART blocks at a time.
Repeated rows give repeated rows; an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FPS = 25
SIDE = 8  # blocks; a frame has up to SIDE x SIDE of them
PART = 1 << 14  # blocks handled at once
BINS, LEAST_CHANGE, TRAIL, DEVIATIONS = 16, 8, 12, 3  # a cut differs in 1/LEAST_CHANGE of the pixels at least
#: Code lengths of the categories 1-8, short for those of ASCII letters. They leave the code of all ones free.
LENGTHS = {5: 2, 4: 2, 7: 3, 3: 3, 6: 4, 8: 4, 2: 5, 1: 5}


def _zigzag() -> np.ndarray:
    """Place in an 8 x 8 block (row-major) of each coefficient in coded order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_u, _x = np.arange(8)[:, None], np.arange(8)[None, :]
#: Inverse DCT basis in 1/2048; sums of such products are exact in doubles.
_BASIS = np.round(2048 * np.where(_u == 0, np.sqrt(0.5), 1) / 2 * np.cos((2 * _x + 1) * _u * np.pi / 16))


def _huffman(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """DHT body (counts, symbols) and symbol -> (code, length) of the canonical code."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = code, last
        code += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order), codes


_DHT, _CODES = _huffman(LENGTHS)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    """Bits (code and magnitude) and their number for each payload byte."""
    bits, count = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for b in range(256):
        c = b - 128 if b < 128 else b - 127
        size = abs(c).bit_length()
        code, n = _CODES[size]
        bits[b], count[b] = code << size | (c if c > 0 else c + (1 << size) - 1), n + size
    return bits, count


_BITS, _COUNT = _coefficients()


def encode_scans(blocks: np.ndarray, firsts: np.ndarray) -> list[bytes]:
    """Entropy-coded data of consecutive frames; ``firsts``: each one's first block and, last, the end."""
    count = _COUNT[blocks]
    used = count.sum(axis=1)
    size = (used + 7) // 8
    start = np.cumsum(size) - size
    at = (start * 8)[:, None] + np.cumsum(count, axis=1) - count
    value = _BITS[blocks] << (24 - count - (at & 7))
    # ones behind each block's last bit
    fill = size * 8 - used
    at, value = np.concatenate([at.ravel() >> 3, start + (used >> 3)]), np.concatenate([value.ravel(), ((1 << fill) - 1) << 16])
    total = int(size.sum())
    raw = np.zeros(total + 3)
    for shift in (16, 8, 0):  # no bit is set twice, so sums do
        raw[: total + 3] += np.bincount(at + (2 - shift // 8), (value >> shift) & 255, total + 3)
    raw = raw[:total].astype(np.uint8)
    last = np.zeros(total, bool)
    last[start + size - 1] = True
    closing = np.zeros(total, bool)
    closing[(start + size - 1)[firsts[1:] - 1]] = True
    full = raw == 255
    width = 1 + full + 2 * (last & ~closing)
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    out[place] = raw
    mark = np.flatnonzero(last & ~closing)
    number = np.arange(len(blocks)) - np.repeat(firsts[:-1], np.diff(firsts))
    number = np.delete(number, firsts[1:] - 1)
    out[place[mark] + 1 + full[mark]] = 255
    out[place[mark] + 2 + full[mark]] = 0xD0 + number % 8
    edges = [*place[start[firsts[:-1]]].tolist(), len(out)]
    return [out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _frame_head(wide: int, high: int) -> bytes:
    return b"".join((b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + b"\1\x11\0"), _segment(0xC4, b"\0" + _DHT), _segment(0xC4, b"\x10" + _DHT), _segment(0xDD, b"\0\1"), _segment(0xDA, b"\1\1\0\0\x3f\0")))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _avi(frames: list[bytes], wide: int, high: int, payload: int) -> bytes:
    largest = max(map(len, frames))
    head = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, 8 * wide, 8 * high, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, 8 * wide, 8 * high)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, 8 * wide, 8 * high, 1, 8, b"MJPG", 64 * wide * high, 0, 0, 0, 0)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % payload))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", head) + strl) + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def encode_files(texts: list[bytes]) -> list[bytes]:
    """An AVI file per text."""
    shape, frames, payload = [], [], []
    for t in texts:
        n = max(1, -(-len(t) // 64))
        wide = min(SIDE, n)
        high = min(SIDE, -(-n // wide))
        shape.append((wide, high))
        payload.append(n * 64)
        frames.append(-(-n // (wide * high)))
    sizes = np.repeat([w * h for w, h in shape], frames)
    raw = b"".join(t.ljust(f * w * h * 64, b"\0") for t, f, (w, h) in zip(texts, frames, shape, strict=True))
    blocks, firsts = np.frombuffer(raw, np.uint8).reshape(-1, 64), np.concatenate([[0], np.cumsum(sizes)])
    scans: list[bytes] = []
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(firsts, firsts[a] + PART, "right")) - 1)
        scans += encode_scans(blocks[firsts[a] : firsts[b]], firsts[a : b + 1] - firsts[a])
        a = b
    heads = {s: _frame_head(*s) for s in set(shape)}
    out, at = [], 0
    for s, f, p in zip(shape, frames, payload, strict=True):
        out.append(_avi([heads[s] + x + b"\xff\xd9" for x in scans[at : at + f]], *s, p))
        at += f
    return out


def _children(data: memoryview, at: int, end: int):
    while at + 8 <= end:
        kind, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError(f"chunk {kind!r} is cut off")
        yield kind, at + 8, at + 8 + size
        at += 8 + size + size % 2


def parse_avi(file: bytes) -> tuple[float, int | None, list[bytes]]:
    """Frames a second, payload bytes if noted, and the frames that the index names."""
    data = memoryview(file)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("no AVI file")
    rate, payload, movi, index = 25.0, None, None, None
    todo = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while todo:
        for kind, a, b in _children(data, *todo.pop()):
            if kind == b"LIST" and bytes(data[a : a + 4]) == b"movi":
                movi = a
            elif kind == b"LIST":
                todo.append((a + 4, b))
            elif kind == b"strh" and bytes(data[a : a + 4]) == b"vids":
                scale, per = struct.unpack_from("<II", data, a + 20)
                rate = per / scale
            elif kind == b"ICMT" and bytes(data[a : a + 8]) == b"payload=":
                payload = int(bytes(data[a + 8 : b]).rstrip(b"\0"))
            elif kind == b"idx1":
                index = a, b
    if movi is None or index is None:
        raise ValueError("no movi list or index")
    frames = []
    for i in range(*index, 16):
        kind, _, offset, size = struct.unpack_from("<4sIII", data, i)
        at = movi + offset
        if bytes(data[at : at + 4]) != kind or struct.unpack_from("<I", data, at + 4)[0] != size:
            raise ValueError("index and chunks differ")
        if kind[2:] == b"dc":
            frames.append(bytes(data[at + 8 : at + 8 + size]))
    return rate, payload, frames


class Head:
    """Tables and geometry of a baseline JPEG frame, up to its scan."""

    def __init__(self, frame: bytes):
        if frame[:2] != b"\xff\xd8":
            raise ValueError("no JPEG frame")
        at, self.interval, quant, tables, self.parts = 2, 0, {}, {}, []
        while True:
            marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
            body = frame[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("16-bit quantisation")
                    quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
                    body = body[65:]
            elif marker == 0xC4:
                while body:
                    counts, symbols = body[1:17], body[17 : 17 + sum(body[1:17])]
                    table, code, k = np.full(1 << 16, -1, np.int32), 0, 0
                    for n in range(1, 17):
                        for _ in range(counts[n - 1]):
                            table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    tables[body[0]] = table
                    body = body[17 + len(symbols) :]
            elif marker == 0xC0:
                self.high, self.wide = struct.unpack_from(">HH", body, 1)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("not a baseline frame")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        self.size = at
        self.quant = quant[self.parts[0][3]]
        if len(self.parts) == 1:  # one component is never interleaved
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.luma = self.parts[0][1] * self.parts[0][2]  # blocks of the first component in a unit
        self.unit = [c for c, (_, h, v, _) in enumerate(self.parts) for _ in range(h * v)]
        big_h, big_v = (max(p[i] for p in self.parts) for i in (1, 2))
        self.units = -(-self.wide // (8 * big_h)) * -(-self.high // (8 * big_v))
        self.tables = np.stack([tables[(kind << 4) | (chosen[c] >> 4 if kind == 0 else chosen[c] & 15)] for c, *_ in self.parts for kind in (0, 1)])


def decode_scans(head: Head, scans: list[bytes]) -> np.ndarray:
    """Quantised coefficients (frame, block in coded order, 64) of frames with the same head, all intervals in step."""
    raw = np.frombuffer(b"".join(scans) + b"\0" * 16, np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in scans])])
    full, after = raw[:-1] == 255, raw[1:]
    restart = np.flatnonzero(full & (after & 0xF8 == 0xD0))
    keep = np.ones(len(raw), bool)
    keep[1:][full & (after == 0)] = False
    keep[restart] = keep[restart + 1] = False
    place = np.cumsum(keep) - keep
    lanes = np.sort(np.concatenate([begins[:-1], restart + 2]))
    per = head.interval or head.units
    if len(lanes) != len(scans) * -(-head.units // per):
        raise ValueError("restart markers")
    data = raw[keep].astype(np.uint64)
    window = np.zeros(len(data), np.uint64)
    for i in range(8):
        window[: len(data) - i] |= data[i:] << np.uint64(56 - 8 * i)
    wide = len(head.unit)
    unit = np.array(head.unit)
    frame_lanes = -(-head.units // per)
    number = np.arange(len(lanes)) % frame_lanes
    frame = np.arange(len(lanes)) // frame_lanes
    ends = np.minimum(per, head.units - number * per) * wide
    out = np.zeros((len(scans) * head.units * wide, 64), np.int16)
    base = (frame * head.units + number * per) * wide
    lane = np.arange(len(lanes))
    bit, k, block = place[lanes] * 8, np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    before = np.zeros((len(lanes), len(head.parts)), np.int64)
    same = 0 if wide == 1 else -1  # the place that all lanes have reached, while no run or short block parts them
    half, range_ = (1 << np.arange(17)) >> 1, (1 << np.arange(17)) - 1
    while len(lane):
        v = window[bit >> 3] << (bit & 7).astype(np.uint64)
        if same >= 0:
            found = head.tables[int(same > 0)][(v >> np.uint64(48)).astype(np.int64)]
            size = found & 255
            if found.min() >= 0 and size.min() > 0 and size.max() < 16:
                length = found >> 8
                low = ((v << length.astype(np.uint64)) >> (np.uint64(64) - size.astype(np.uint64))).astype(np.int64)
                value = low - (low < half[size]) * range_[size]
                if same == 0:
                    value += before[lane, 0]
                    before[lane, 0] = value
                out[base[lane] + block, same] = value
                bit = bit + length + size
                same += 1
                if same == 64:
                    same, block = 0, block + 1
                    stay = block < ends[lane]
                    if not stay.all():
                        lane, bit, block = lane[stay], bit[stay], block[stay]
                continue
            k, same = np.full(len(lane), same), -1
        part = unit[block % wide] if wide > 1 else np.zeros(len(lane), np.int64)
        found = head.tables[2 * part + (k > 0), (v >> np.uint64(48)).astype(np.int64)]
        if (found < 0).any():
            raise ValueError("no such Huffman code")
        length, symbol = found >> 8, found & 255
        dc = k == 0
        run, size = np.where(dc, 0, symbol >> 4), np.where(dc, symbol, symbol & 15)
        n = size.astype(np.uint64)
        low = ((v << length.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - n)).astype(np.int64)
        value = np.where(low < (1 << size >> 1), low - (1 << size) + 1, low)
        if dc.any():
            rows = np.flatnonzero(dc)
            before[lane[rows], part[rows]] += value[rows]
            value[rows] = before[lane[rows], part[rows]]
        put = dc | (size > 0)
        k = k + run
        if (k > 63).any():
            raise ValueError("run past the end of a block")
        rows = np.flatnonzero(put)
        out[(base[lane] + block)[rows], k[rows]] = value[rows]
        k = np.where(put | (run == 15), k + 1, 64)
        bit = bit + length + size
        done = k >= 64
        if done.any():
            block = block + done
            k = np.where(done, 0, k)
            stay = block < ends[lane]
            if not stay.all():
                lane, bit, k, block = lane[stay], bit[stay], k[stay], block[stay]
    return out.reshape(len(scans), head.units * wide, 64)


def histograms(head: Head, coefficients: np.ndarray) -> np.ndarray:
    """Luma histogram (BINS values) of each frame, over whole blocks."""
    luma = np.array([c == 0 for c in head.unit] * head.units)
    own = coefficients[:, luma] * head.quant
    grid = np.zeros((own.shape[0] * own.shape[1], 64))
    grid[:, ZIGZAG] = own.reshape(-1, 64)
    grid = grid.reshape(-1, 8, 8)
    rows = (grid.reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8)
    pixels = (rows.transpose(0, 2, 1).reshape(-1, 8) @ _BASIS).reshape(len(own), -1)
    pixels = np.clip(np.floor(pixels / (1 << 22) + 128.5), 0, 255).astype(np.int64) * BINS // 256
    return np.bincount((pixels + BINS * np.arange(len(own))[:, None]).ravel(), minlength=BINS * len(own)).reshape(len(own), BINS)


def cuts(counts: np.ndarray) -> list[int]:
    """First frames of the shots: where a histogram difference exceeds the trailing mean by DEVIATIONS deviations."""
    out, trail = [0], []
    pixels = int(counts[0].sum())
    for t, d in enumerate((np.abs(np.diff(counts, axis=0)).sum(axis=1) // 2).tolist(), 1):
        m, s, q = len(trail), sum(trail), sum(x * x for x in trail)
        over = d * m - s
        if d * LEAST_CHANGE >= pixels and (m == 0 or over > 0 and over * over > DEVIATIONS**2 * (m * q - s * s)):
            out.append(t)
            trail = []
        else:
            trail = [*trail[1 - TRAIL :], d]
    return out


def decode_files(files: list[bytes]) -> list[dict]:
    """Of each file: payload (if its size is noted), frames a second, frame histograms and first frames of the clips."""
    parsed = [parse_avi(f) for f in files]
    groups: dict[bytes, list[tuple[int, int, bytes]]] = {}
    heads: dict[bytes, Head] = {}
    for i, (_, _, frames) in enumerate(parsed):
        for j, f in enumerate(frames):
            key = next((k for k in heads if f.startswith(k)), None)
            if key is None:
                head = Head(f)
                key = f[: head.size]
                heads[key] = head
            groups.setdefault(key, []).append((i, j, f[len(key) : f.rindex(b"\xff\xd9")]))
    payloads: list[list] = [[None] * len(p[2]) for p in parsed]
    counts: list[list] = [[None] * len(p[2]) for p in parsed]
    for key, members in groups.items():
        head = heads[key]
        step = max(1, PART // (head.units * len(head.unit)))
        for a in range(0, len(members), step):
            part = members[a : a + step]
            got = decode_scans(head, [x[2] for x in part])
            seen = histograms(head, got)
            for (i, j, _), c, h in zip(part, got, seen, strict=True):
                counts[i][j] = h
                if parsed[i][1] is not None:
                    payloads[i][j] = np.where(c < 0, c + 128, c + 127).astype(np.uint8).tobytes()
    return [{"fps": p[0], "payload": None if p[1] is None else b"".join(own)[: p[1]], "counts": np.array(c), "cuts": cuts(np.array(c)) if c else []} for p, own, c in zip(parsed, payloads, counts, strict=True)]


def _slices(batch: pa.RecordBatch, column: str):
    """Rows of about a megabyte at a time."""
    sizes = np.array([len(x) if x is not None else 0 for x in (v.as_buffer() for v in batch.column(column))], np.int64)
    block = np.cumsum(sizes) >> 20
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, avi): every text's file."""

    def build(batches):
        for batch in batches:
            for part in _slices(batch, "text"):
                texts = [x or b"" for x in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode_files(texts), pa.binary())], ["doc_id", "n_bytes", "avi"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(build, "doc_id long, n_bytes long, avi binary")


def clips(files: DataFrame, key: str = "doc_id", avi: str = "avi") -> DataFrame:
    """A row per clip: its first frame, number of frames, start and end in seconds, and mean histogram bin."""

    def read(batches):
        for batch in batches:
            for part in _slices(batch, "avi"):
                rows = []
                for x, f in zip(part.column("key").to_pylist(), decode_files(part.column("avi").to_pylist()), strict=True):
                    edges = [*f["cuts"], len(f["counts"])]
                    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        own = f["counts"][a:b].sum(axis=0)
                        rows.append((x, i, a, b - a, a / f["fps"], b / f["fps"], float((own * np.arange(BINS)).sum() / own.sum())))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "clip", "first_frame", "frames", "start_s", "end_s", "mean_bin"])

    return files.where(F.col(avi).isNotNull()).select(F.col(key).alias("key"), F.col(avi).alias("avi")).mapInArrow(read, "doc_id long, clip int, first_frame long, frames long, start_s double, end_s double, mean_bin double")


def digests(files: DataFrame) -> DataFrame:
    """Payload and feature digests of every file of ``media``, read back from its bytes."""

    def read(batches):
        for batch in batches:
            for part in _slices(batch, "avi"):
                own = part.column("avi").to_pylist()
                rows = []
                for data, f in zip(own, decode_files(own), strict=True):
                    p, total = f["payload"], f["counts"].sum(axis=0)
                    feature = f"frames={len(f['counts'])};clips={','.join(map(str, f['cuts']))};bins={','.join(map(str, total.tolist()))}"
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return files.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
