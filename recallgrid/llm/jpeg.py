"""Media columns: baseline JPEG headers, Huffman scans and DC-only luminance thumbnails in numpy.

A scan's bit string is looked at from every bit at once: one table look-up per position gives the code there, how far
it reaches and what it holds, so that walking a block costs one list access per coefficient and no bit arithmetic. AC
coefficients are stepped over, never reconstructed; the DC coefficient of each 8x8 luminance block is one pixel.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 15  # bytes of a scan that are looked at together
FIELDS = "status string, width int, height int, components int, thumb_width int, thumb_height int, thumb_dhash bigint, thumb_md5 string"


class Bad(ValueError):
    """What is wrong with the bytes, as the status column names it, and the frame (width, height, components) if known."""

    def __init__(self, status: str, frame: tuple[int, int, int] | None = None):
        super().__init__(status)
        self.frame = frame


@functools.lru_cache(maxsize=256)
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length (0: no code) and symbol for every 16 bits, from the 16 counts and the symbols of a DHT table."""
    size, sym, at, k = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            step = 1 << (16 - length)
            if at + step > 1 << 16 or k >= len(table):
                raise Bad("corrupt")
            size[at : at + step], sym[at : at + step] = length, table[k]
            at, k = at + step, k + 1
    return size, sym


def parse(data: bytes) -> dict:
    """Frame, tables and place of the scan that holds the first component of a baseline JPEG."""
    if len(data) < 4 or data[:2] != b"\xff\xd8":
        raise Bad("not_jpeg")
    out, at, seen = {"quant": {}, "huff": {}, "restart": 0, "frame": None}, 2, None
    while True:
        while at < len(data) and data[at] != 0xFF:
            at += 1
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            raise Bad("corrupt", seen)
        mark = data[at]
        at += 1
        if mark == 0xD9:
            raise Bad("corrupt", seen)
        if mark in (0x00, 0x01) or 0xD0 <= mark <= 0xD8:  # 00 and restarts: inside a scan that is passed over
            continue
        if at + 2 > len(data):
            raise Bad("corrupt", seen)
        size = int.from_bytes(data[at : at + 2], "big")
        body, after = data[at + 2 : at + size], at + size
        if size < 2 or after > len(data):
            raise Bad("corrupt", seen)
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                n = 128 if wide else 64
                if k + 1 + n > len(body):
                    raise Bad("corrupt", seen)
                out["quant"][name] = int.from_bytes(body[k + 1 : k + 3], "big") if wide else body[k + 1]  # of DC
                k += 1 + n
        elif mark == 0xC4:
            k = 0
            while k + 17 <= len(body):
                n = sum(body[k + 1 : k + 17])
                out["huff"][body[k]] = bytes(body[k + 1 : k + 17 + n])
                k += 17 + n
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise Bad("corrupt")
            out["frame"] = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])])
            seen = (*out["frame"][:2], body[5])
            if mark > 0xC1 or body[0] != 8:
                raise Bad("unsupported", seen)
        elif mark == 0xDD:
            out["restart"] = int.from_bytes(body[:2], "big")
        elif mark == 0xDA:
            if not out["frame"]:
                raise Bad("corrupt")
            n = body[0] if body else 0
            if len(body) < 1 + 2 * n or not out["frame"][2]:
                raise Bad("corrupt", seen)
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            if out["frame"][2][0][0] in [c for c, _, _ in out["scan"]]:
                out["at"] = after
                return out
        at = after


class _Bits:
    """One entropy-coded segment, seen from every bit of a chunk."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.base, self.top = raw, 0, -1
        self.bits = 8 * len(raw)

    def load(self, bit: int) -> None:
        first = bit // 8
        part = self.raw[first : first + CHUNK + 512].astype(np.uint32)
        pad = np.concatenate((part, np.full(3, 255, np.uint32)))
        word = (pad[:-2] << 16 | pad[1:-1] << 8 | pad[2:])[: len(part)]
        self.peek = (word[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)[None, :] & 0xFFFF).ravel()
        self.base, self.top, self.made = 8 * first, 8 * (first + CHUNK), {}

    def steps(self, table: bytes) -> tuple[list, list, list]:
        got = self.made.get(table)
        if got is None:
            size, sym = _lookup(table)
            n, s = size[self.peek], sym[self.peek]
            got = self.made[table] = (n.tolist(), s.tolist(), np.where(n > 0, n + (s & 15), 0).tolist())
        return got


def luminance_dc(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(width, height, components, one pixel 0 .. 255 for each 8x8 luminance block)."""
    p = parse(data)
    width, height, comps = p["frame"]
    known = (width, height, len(comps))
    if not width or not height or len(comps) not in (1, 3, 4):
        raise Bad("unsupported", known)
    scan = {c: (dc, ac) for c, dc, ac in p["scan"]}
    if not set(scan) <= {c[0] for c in comps}:
        raise Bad("corrupt", known)
    for c, h, v, q in comps:
        if not (1 <= h <= 4 and 1 <= v <= 4) or (c in scan and (q not in p["quant"] or scan[c][0] not in p["huff"] or 16 + scan[c][1] not in p["huff"])):
            raise Bad("corrupt", known)
    quant, (yh, yv) = p["quant"][comps[0][3]], comps[0][1:3]
    hm, vm = max(c[1] for c in comps), max(c[2] for c in comps)
    bw, bh = -(-width * yh // (8 * hm)), -(-height * yv // (8 * vm))
    comps = [c for c in comps if c[0] in scan]
    if len(comps) == 1:  # one component a scan: its blocks row by row, without padding
        mw, mh, yh, yv = bw, bh, 1, 1
        comps = [(comps[0][0], 1, 1, comps[0][3])]
    else:
        mw, mh = -(-width // (8 * hm)), -(-height // (8 * vm))
    dc = np.zeros((mh * yv, mw * yh), np.int64)
    rest = np.frombuffer(data, np.uint8)[p["at"] :]
    ff = np.flatnonzero(rest[:-1] == 255) if len(rest) > 1 else np.zeros(0, np.int64)
    nxt = rest[ff + 1]
    stops = ff[(nxt != 0) & (nxt != 255) & ~((nxt >= 0xD0) & (nxt <= 0xD7))]
    end = int(stops[0]) if len(stops) else len(rest)
    cuts = ff[(nxt >= 0xD0) & (nxt <= 0xD7) & (ff < end)]
    segments, last = [], 0
    for c in [*cuts.tolist(), end]:
        seg = rest[last:c]
        keep = np.ones(len(seg), bool)
        keep[1:] = ~((seg[1:] == 0) & (seg[:-1] == 255))
        segments.append(seg[keep])
        last = c + 2
    per, total, mcu = p["restart"] or mw * mh, mw * mh, 0
    order = [(i, x, y, p["huff"][scan[c][0]], p["huff"][16 + scan[c][1]]) for i, (c, h, v, _) in enumerate(comps) for y in range(v) for x in range(h)]
    for raw in segments:
        if mcu >= total:
            break
        b, bit, before = _Bits(raw), 0, [0] * len(comps)
        for m in range(mcu, min(mcu + per, total)):
            my, mx = divmod(m, mw)
            for i, x, y, dct, act in order:
                if bit >= b.top:
                    b.load(bit)
                base = b.base
                size, sym, go = b.steps(dct)
                at = bit - base
                if bit >= b.bits or not go[at]:
                    raise Bad("corrupt", known)
                s = sym[at]
                if s:
                    if s > 15:
                        raise Bad("corrupt", known)
                    val = at + size[at]
                    v = int(b.peek[val]) >> (16 - s) if val < len(b.peek) else 0
                    before[i] += v if v >> (s - 1) else v - (1 << s) + 1
                at += go[at]
                if i == 0:
                    dc[my * yv + y, mx * yh + x] = before[0]
                _, sym, go = b.steps(act)
                k, n = 1, len(go)
                while k < 64:
                    if at >= n or not go[at]:
                        raise Bad("corrupt", known)
                    s = sym[at]
                    at += go[at]
                    if s == 0:
                        break
                    k += 16 if s == 0xF0 else (s >> 4) + 1
                bit = base + at
                if bit > b.bits:
                    raise Bad("corrupt", known)
        mcu += per
    if mcu < total:
        raise Bad("corrupt", known)
    pix = np.clip(np.rint(dc[:bh, :bw] * quant / 8 + 128), 0, 255).astype(np.uint8)
    return *known, pix


def dhash(pix: np.ndarray) -> int:
    """64 bits: is a cell darker than the one on its right, over 9 x 8 means of the thumbnail; as a signed number."""
    h, w = pix.shape
    ys, xs = np.linspace(0, h, 9), np.linspace(0, w, 10)
    area = np.zeros((h + 1, w + 1))
    area[1:, 1:] = pix.astype(np.float64).cumsum(0).cumsum(1)

    def at(y, x):
        y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        a, b = area[y0], area[y0 + 1]
        return (a[:, x0] * (1 - fx) + a[:, x0 + 1] * fx) * (1 - fy) + (b[:, x0] * (1 - fx) + b[:, x0 + 1] * fx) * fy

    s = at(ys, xs)
    cell = np.round(s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1], 6)
    return int(np.packbits((cell[:, :-1] < cell[:, 1:]).ravel()).view(">i8")[0])


def describe(data: bytes | None) -> tuple:
    """The FIELDS of one value; unless it is ok, all but status and what a frame header says of the size are null."""
    if data is None:
        return ("null", *[None] * 7)
    try:
        w, h, n, pix = luminance_dc(data)
    except Bad as e:
        return (str(e), *(e.frame or [None] * 3), *[None] * 4)
    return ("ok", w, h, n, pix.shape[1], pix.shape[0], dhash(pix), hashlib.md5(pix.tobytes()).hexdigest())


def media_columns(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """(id_col, FIELDS) of every row: dimensions, thumbnail size and hashes of a binary column.

    status: ok, null, not_jpeg, unsupported (progressive, arithmetic, 12 bits) or corrupt (cut or broken; empty bytes are
    not_jpeg). Dimensions are there whenever the frame header is. Only the two columns are read, large values whole; rows
    that repeat are described each; an empty table gives no row.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [describe(x.as_py()) for x in b.column(1)]
            cols = list(zip(*rows)) if rows else [[]] * 8
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["id", *[f.split()[0] for f in FIELDS.split(", ")]])

    return df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, f"id {kind}, {FIELDS}").withColumnRenamed("id", id_col)


# ---- a writer of baseline JPEG, which turns the driver's pages (they hold no images) into a media column ----

_DC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
_ZIG = [y * 8 + x for s in range(15) for y, x in sorted(((y, s - y) for y in range(8) if 0 <= s - y < 8), key=lambda p: p[0] if s % 2 else -p[0])]


@functools.lru_cache(maxsize=1)
def _ac_table() -> bytes:
    """A complete canonical code: short for end of block and small values after short runs, else 8 to 12 bits."""
    order = sorted((r << 4 | s for r in range(16) for s in range(1, 11)), key=lambda v: ((v >> 4) + 2 * (v & 15), v))
    counts, symbols = [0] * 16, [0x00, *order[:2], *order[2:8], 0xF0, *order[8:]]
    for length, n in ((2, 1), (3, 2), (5, 6), (8, 24), (12, 129)):
        counts[length - 1] = n
    return bytes(counts) + bytes(symbols[:162])


@functools.lru_cache(maxsize=4)
def _codes(table: bytes) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[table[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


_T = np.array([[(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def encode(planes: list[np.ndarray], sampling: list[tuple[int, int]], width: int, height: int, quant: int = 12, restart: int = 0) -> bytes:
    """A baseline JPEG of planes (values 0 .. 255, each padded to whole MCUs)."""
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    mw, mh = -(-width // (8 * hm)), -(-height // (8 * vm))
    q = np.minimum(255, quant + 2 * np.add.outer(np.arange(8), np.arange(8))).astype(np.int64)
    blocks = []
    for p in planes:
        b = p.astype(np.float64).reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3) - 128
        blocks.append(np.rint(_T @ b @ _T.T / q).astype(np.int64).reshape(p.shape[0] // 8, p.shape[1] // 8, 64)[:, :, _ZIG])
    dct, act = _codes(_DC), _codes(_ac_table())
    scan, word, used, before = bytearray(), 0, 0, [0] * len(planes)

    def flush():
        nonlocal word, used
        pad = -used % 8
        raw = ((word << pad | (1 << pad) - 1)).to_bytes((used + pad) // 8, "big")
        scan.extend(raw.replace(b"\xff", b"\xff\x00"))
        word = used = 0

    for m in range(mw * mh):
        if restart and m and m % restart == 0:
            flush()
            scan.extend(bytes([0xFF, 0xD0 + (m // restart - 1) % 8]))
            before = [0] * len(planes)
        my, mx = divmod(m, mw)
        for i, (h, v) in enumerate(sampling):
            for y in range(v):
                for x in range(h):
                    z = blocks[i][my * v + y, mx * h + x]
                    d = int(z[0]) - before[i]
                    before[i] = int(z[0])
                    s = abs(d).bit_length()
                    c, n = dct[s]
                    word, used = (word << n | c) << s | (d if d >= 0 else d + (1 << s) - 1), used + n + s
                    last = 0
                    for k in np.flatnonzero(z[1:]).tolist():
                        k += 1
                        run, a = k - last - 1, int(z[k])
                        while run > 15:
                            c, n = act[0xF0]
                            word, used, run = word << n | c, used + n, run - 16
                        s = abs(a).bit_length()
                        c, n = act[run << 4 | s]
                        word, used = (word << n | c) << s | (a if a >= 0 else a + (1 << s) - 1), used + n + s
                        last = k
                    if last < 63:
                        c, n = act[0]
                        word, used = word << n | c, used + n
    flush()

    def seg(mark: int, body: bytes) -> bytes:
        return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body

    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, b"\0" + bytes(q.ravel()[_ZIG].astype(np.uint8).tolist()))
    head += seg(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += seg(0xC4, b"\x00" + _DC) + seg(0xC4, b"\x10" + _ac_table())
    if restart:
        head += seg(0xDD, restart.to_bytes(2, "big"))
    return head + seg(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0") + bytes(scan) + b"\xff\xd9"


def page_picture(html: bytes) -> bytes:
    """A picture of a page: its bytes, folded into 4 x 4 pixels a cell, with flat colour planes at half size."""
    raw = np.frombuffer(html, np.uint8)
    w, h = 24 + len(raw) % 5 * 8, 16 + len(raw) % 3 * 8
    pw, ph = -(-w // 16) * 16, -(-h // 16) * 16
    cells = pw * ph // 16
    sums = np.bincount(np.arange(len(raw)) * cells // max(len(raw), 1), raw, cells) if len(raw) else np.zeros(cells)
    luma = (sums * 7 % 256).reshape(ph // 4, pw // 4).repeat(4, 0).repeat(4, 1)
    tint = float(len(raw) * 31 % 256)
    return encode([luma, np.full((ph // 2, pw // 2), tint), np.full((ph // 2, pw // 2), 255 - tint)], [(2, 2), (1, 1), (1, 1)], w, h, quant=24, restart=2)


def with_picture(pages: DataFrame, html_col: str = "html", out: str = "media") -> DataFrame:
    """``pages`` with a binary column of page_picture; null where the page is null."""

    @F.arrow_udf("binary")
    def picture(arr: pa.Array) -> pa.Array:
        return pa.array([None if x.as_py() is None else page_picture(x.as_py().encode()) for x in arr], pa.binary())

    return pages.withColumn(out, picture(F.col(html_col).cast("string")))
