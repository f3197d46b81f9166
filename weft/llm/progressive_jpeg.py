"""Media columns of progressive JPEG: a decoder and an encoder in numpy, for many images at a time.

Decoding goes through the scans in order. Each scan adds to the coefficient arrays: the first scan of a band brings the
upper bits (spectral selection), later scans one bit more (successive approximation). Then come dequantisation, the
inverse transform, chroma upsampling and the colour transform to full-resolution RGB.

Entropy-coded data are sequential, but restart markers part them into intervals that don't depend on each other. All
intervals of the same scan of all images of a batch are decoded in lockstep, one per lane of the numpy arrays.

Bytes are stored losslessly in the format's own unit, the quantised coefficient: byte b becomes the value b - 128 at the
next place of the zigzag order of the next block, luma blocks first, then both chroma planes. Coefficients survive
entropy coding exactly, samples wouldn't survive the transform's rounding. The length stands in an APP9 segment.
Payloads above TILE bytes become several images, one after the other, so no array grows with a text.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._common import bound_batches, slices, table, utf8

UNIT = 576
#: Bytes in one image, a multiple of UNIT; bytes handled in one pass; restart interval; widest image in units of 16.
TILE, PASS, RESTART, WIDE = UNIT * 910, 768 << 10, 2, 32
#: The zigzag order: place in the scan -> place in the block, by its rule (diagonals in turn).
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
#: (components, first, last coefficient, bits before, bits after) of the scans that the encoder writes.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), *(((c,), 1, 5, 0, 1) for c in range(3)), *(((c,), 6, 63, 0, 1) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0), *(((c,), 1, 63, 1, 0) for c in range(3))]
SAMPLING = ((2, 2), (1, 1), (1, 1))
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


# ---------------------------------------------------------------------------------------------------- Huffman tables
def _table(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol of a canonical table."""
    code, at, codes, lengths = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            codes[s], lengths[s] = code, bits
            code += 1
        at += n
        code <<= 1
    return codes, lengths


def _lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """The next 16 bits -> length * 256 + symbol; 0 where no code begins so."""
    out = np.zeros(65536, np.int64)
    codes, lengths = _table(counts, symbols)
    for s in symbols:
        a = int(codes[s]) << (16 - int(lengths[s]))
        out[a : a + (1 << (16 - int(lengths[s])))] = int(lengths[s]) * 256 + s
    return out


#: The encoder's tables: four bits for what texts need all the time, ten for every other symbol.
_SHORT = [0x00, *range(1, 8)]
DC_TABLE = ([0, 0, 0, 12] + [0] * 12, list(range(12)))
AC_TABLE = ([0, 0, 0, 8, 0, 0, 0, 0, 0, 248] + [0] * 6, _SHORT + [s for s in range(256) if s not in _SHORT])
_DC, _AC = _table(*DC_TABLE), _table(*AC_TABLE)
_SIZE = np.array([i.bit_length() for i in range(2048)], np.int64)


# ------------------------------------------------------------------------------------------------------------ encoder
def _pack(codes: np.ndarray, lengths: np.ndarray, first_rows: np.ndarray, image_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of rows, a byte-aligned interval from each of first_rows, stuffed and parted by restart markers.

    image_starts: which intervals are the first of an image. Returns the bytes and where each image's begin (and the end).
    """
    codes = np.where(lengths > 0, codes, 0).astype(np.uint64)
    while codes.shape[1] > 1:  # neighbours become one item as long as all fit into a word
        if codes.shape[1] % 2:
            codes, lengths = (np.concatenate([x, np.zeros((len(x), 1), x.dtype)], axis=1) for x in (codes, lengths))
        both = lengths[:, ::2] + lengths[:, 1::2]
        if both.max() > 57:
            break
        codes = codes[:, ::2] << lengths[:, 1::2].astype(np.uint64) | codes[:, 1::2]
        lengths = both
    per_row = lengths.sum(axis=1)
    bits = np.add.reduceat(per_row, first_rows)
    size = (bits + 7) // 8
    offset = np.concatenate(([0], np.cumsum(size)))
    interval = np.repeat(np.arange(len(first_rows)), np.diff(np.append(first_rows, len(per_row))))
    before = np.cumsum(per_row) - per_row
    row_at = offset[interval] * 8 + before - before[first_rows][interval]
    at = row_at[:, None] + np.cumsum(lengths, axis=1) - lengths
    some = lengths > 0
    at, code, n = at[some], codes[some], lengths[some]
    value = code << (64 - n - (at & 7)).astype(np.uint64)
    total = int(offset[-1])
    out = np.zeros(total + 8)
    wide = n > 17
    for j in range(8):
        pick = slice(None) if j < 3 else wide
        if j >= 3 and not wide.any():
            break
        out += np.bincount((at[pick] >> 3) + j, ((value[pick] >> np.uint64(56 - 8 * j)) & np.uint64(255)).astype(np.float64), total + 8)
    data = out[:total].astype(np.uint8)
    data[offset[1:] - 1] |= ((1 << (-bits % 8)) - 1).astype(np.uint8)
    shift = np.zeros(total + 1, np.int64)
    full = np.flatnonzero(data == 255)
    shift[full + 1] += 1
    first = np.zeros(len(first_rows), bool)
    first[image_starts] = True
    later = np.flatnonzero(~first)
    shift[offset[later]] += 2
    place = np.arange(total + 1) + np.cumsum(shift)
    stuffed = np.zeros(int(place[-1]), np.uint8)
    stuffed[place[:-1]] = data
    number = np.arange(len(first_rows)) - np.maximum.accumulate(np.where(first, np.arange(len(first_rows)), 0)) - 1
    stuffed[place[offset[later]] - 2] = 255
    stuffed[place[offset[later]] - 1] = 0xD0 + number[later] % 8
    return stuffed, np.append(place[offset[np.flatnonzero(first)]], place[-1])


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = _SIZE[np.abs(v)]
    return size, np.where(v > 0, v, v + (1 << size) - 1).astype(np.uint64)


def _ac_first(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and length at each coefficient of a band, and for the end of the block."""
    codes, lengths = _AC
    n, band = q.shape
    some = q != 0
    index = np.where(some, np.arange(band), -1)
    last = np.maximum.accumulate(index, axis=1)
    run = np.arange(band) - np.concatenate([np.full((n, 1), -1), last[:, :-1]], axis=1) - 1
    size, extra = _magnitude(q)
    symbol = np.where(some, (run & 15) << 4 | size, 0)
    zeros, zero_code, zero_bits = run >> 4, codes[0xF0], int(lengths[0xF0])
    repeated = np.array([sum(int(zero_code) << (zero_bits * j) for j in range(z)) for z in range(4)], np.uint64)
    code = (repeated[zeros] << lengths[symbol].astype(np.uint64) | codes[symbol]) << size.astype(np.uint64) | extra
    length = np.where(some, zeros * zero_bits + lengths[symbol] + size, 0)
    ended = last[:, -1] == band - 1
    return np.concatenate([np.where(some, code, 0), np.full((n, 1), codes[0])], axis=1), np.concatenate([length, np.where(ended, 0, lengths[0])[:, None]], axis=1)


def _ac_refine(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest bit of a band: correction bits of known coefficients, and the codes of new ones."""
    codes, lengths = _AC
    a = np.abs(q)
    n, band = q.shape
    code, length = np.zeros((n, band + 5), np.uint64), np.zeros((n, band + 5), np.int64)
    code[:, 0], length[:, 0] = codes[0], lengths[0]
    code[:, 1 : band + 1], length[:, 1 : band + 1] = a & 1, a > 1
    for i in np.flatnonzero((a == 1).any(axis=1)):
        items, run, held = [], 0, []
        newest = int(np.flatnonzero(a[i] == 1)[-1])
        for k, (m, v) in enumerate(zip(a[i].tolist(), q[i].tolist(), strict=True)):
            if not m:
                run += 1
                continue
            while run > 15 and k <= newest:
                items += [(int(codes[0xF0]), int(lengths[0xF0])), *held]
                held, run = [], run - 16
            if m > 1:
                held.append((m & 1, 1))
                continue
            s = run << 4 | 1
            items += [(int(codes[s]) << 1 | (v > 0), int(lengths[s]) + 1), *held]
            held, run = [], 0
        if run or held:
            items += [(int(codes[0]), int(lengths[0])), *held]
        code[i], length[i] = 0, 0
        code[i, : len(items)] = [c for c, _ in items]
        length[i, : len(items)] = [b for _, b in items]
    return code, length


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _huffman(kind: int, spec: tuple[list[int], list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind, *spec[0], *spec[1]]))


def _scan_header(parts: tuple[int, ...], lo: int, hi: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *(x for c in parts for x in (c + 1, 0)), lo, hi, high << 4 | low]))


def _shape(blocks: int) -> tuple[int, int]:
    """Rows and columns of 16 x 16 units that hold so many blocks."""
    units = -(-blocks // 6)
    wide = min(units, WIDE)
    return -(-units // wide), wide


def encode(payloads: list[bytes]) -> list[bytes]:
    """One progressive image for each payload, whose length is a positive multiple of 64 of at most TILE bytes."""
    shapes = [_shape(len(p) // 64) for p in payloads]
    values, orders, parts = [], [], [[], [], []]
    base = 0
    for p, (h, w) in zip(payloads, shapes, strict=True):
        q = np.zeros((6 * h * w, 64), np.int64)
        q[: len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int64) - 128
        values.append(q)
        luma = np.arange(4 * h * w).reshape(h, 2, w, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
        units = np.arange(h * w)[:, None]
        orders.append(base + np.concatenate([luma, 4 * h * w + units, 5 * h * w + units], axis=1))
        for c, (a, b) in enumerate(((0, 4), (4, 5), (5, 6))):
            parts[c].append(base + np.arange(a * h * w, b * h * w))
        base += 6 * h * w
    q = np.concatenate(values)
    bodies = []
    for comps, lo, hi, high, low in SCRIPT:
        rows_of = orders if len(comps) == 3 else parts[comps[0]]
        counts = np.array([len(r) for r in rows_of])
        starts = np.cumsum(counts) - counts
        first = np.concatenate([np.arange(s, s + n, RESTART) for s, n in zip(starts, counts, strict=True)])
        rows = np.concatenate(rows_of)
        if lo == 0 and not high:
            dc = q[:, 0][rows] >> low
            before = np.concatenate([np.concatenate([np.zeros((1, 6), np.int64), dc[:-1]])[:, 3:4], dc[:, :3], np.concatenate([np.zeros((1, 6), np.int64), dc[:-1]])[:, 4:]], axis=1)
            before[first, 0], before[first, 4:] = 0, 0
            size, extra = _magnitude(dc - before)
            code, length = _DC[0][size] << size.astype(np.uint64) | extra, _DC[1][size] + size
        elif lo == 0:
            code, length = ((q[:, 0][rows] >> low) & 1).astype(np.uint64), np.ones(rows.shape, np.int64)
        elif not high:
            band = q[rows, lo : hi + 1]
            code, length = _ac_first(np.sign(band) * (np.abs(band) >> low))
        else:
            code, length = _ac_refine(q[rows, lo : hi + 1])
        bodies.append(_pack(code, length, first, np.searchsorted(first, starts)))
    tables = _segment(0xDB, bytes([0, *[1] * 64]))
    coding = _huffman(0x00, DC_TABLE) + _huffman(0x10, AC_TABLE) + _segment(0xDD, struct.pack(">H", RESTART))
    headers = [_scan_header(*s) for s in SCRIPT]
    out = []
    for i, (p, (h, w)) in enumerate(zip(payloads, shapes, strict=True)):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"".join(bytes([c + 1, x << 4 | y, 0]) for c, (x, y) in enumerate(SAMPLING))
        pieces = [b"\xff\xd8", _segment(0xE9, b"WEFT" + struct.pack(">Q", len(p))), tables, _segment(0xC2, frame), coding]
        for head, (data, at) in zip(headers, bodies, strict=True):
            pieces += [head, data[at[i] : at[i + 1]].tobytes()]
        out.append(b"".join([*pieces, b"\xff\xd9"]))
    return out


# ------------------------------------------------------------------------------------------------------------ decoder
class Huffman:
    """A table for decoding. Equal tables are one object, so comparing and hashing are cheap."""

    def __init__(self, counts: tuple[int, ...], symbols: tuple[int, ...]):
        self.lookup = _lookup(list(counts), list(symbols))


_huffman_of = lru_cache(64)(Huffman)


@lru_cache(64)
def _huffman_tables(body: bytes) -> tuple[tuple[int, Huffman], ...]:
    out = []
    while body:
        count = sum(body[1:17])
        out.append((body[0], _huffman_of(tuple(body[1:17]), tuple(body[17 : 17 + count]))))
        body = body[17 + count :]
    return tuple(out)


@lru_cache(64)
def _quantisation_tables(body: bytes) -> tuple[tuple[int, np.ndarray], ...]:
    out = []
    while body:
        wide = body[0] >> 4
        out.append((body[0] & 15, np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)))
        body = body[65 + 64 * wide :]
    return tuple(out)


@dataclass
class Image:
    height: int = 0
    width: int = 0
    length: int = -1  # of the payload, if there is one
    parts: list = field(default_factory=list)  # (id, horizontal, vertical, quantisation table)
    tables: dict = field(default_factory=dict)
    scans: list = field(default_factory=list)  # (signature, start, end)
    base: int = 0
    grids: list = field(default_factory=list)  # (padded rows, padded columns, rows, columns, first block of the image's)

    def key(self):
        return (tuple(self.parts), tuple(s for s, _, _ in self.scans))


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """The image that starts at this place, and where it ends. Progressive Huffman images of eight bits only."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no image starts here")
    image, at, huffman, restart = Image(), at + 2, {}, 0
    while True:
        while data[at] == 255 and data[at + 1] == 255:
            at += 1
        if at + 2 > len(data) or data[at] != 255:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            return image, at + 2
        n = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            image.tables.update(_quantisation_tables(body))
        elif marker == 0xC4:
            huffman.update(_huffman_tables(body))
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xE9 and body[:4] == b"WEFT":
            image.length = struct.unpack(">Q", body[4:12])[0]
        elif marker == 0xC2:
            depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3):
                raise ValueError("eight bits, one or three components are expected")
            image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("the image isn't progressive with Huffman codes")
        elif marker == 0xDA:
            n = body[0]
            ids = [p[0] for p in image.parts]
            comps = tuple((ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n))
            lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(huffman.get(c[1]) if not lo else huffman.get(0x10 | c[2]) for c in comps) if lo or not approx >> 4 else ()
            stop = _MARKER.search(data, at)
            if not stop:
                raise ValueError("a scan doesn't end")
            image.scans.append(((tuple(c[0] for c in comps), lo, hi, approx >> 4, approx & 15, restart, used), at, stop.start()))
            at = stop.start()


def _lay_out(image: Image, base: int) -> int:
    """Number the blocks of an image from base; the number after the last."""
    image.base, hm, vm = base, max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    mcu_rows, mcu_cols = -(-image.height // (8 * vm)), -(-image.width // (8 * hm))
    image.grids, own = [], 0
    for _, h, v, _ in image.parts:
        rows, cols = -(-(-(-image.height * v // vm)) // 8), -(-(-(-image.width * h // hm)) // 8)
        image.grids.append((mcu_rows * v, mcu_cols * h, rows, cols, own))
        own += mcu_rows * v * mcu_cols * h
    return base + own


@lru_cache(256)
def _places(grids: tuple, parts: tuple, comps: tuple[int, ...]) -> np.ndarray:
    """Block numbers, counted from the image's first, in the order of a scan: one row for each unit."""
    if len(comps) == 1:
        _, padded, rows, cols, base = grids[comps[0]]
        return (base + np.arange(rows)[:, None] * padded + np.arange(cols)).reshape(-1, 1)
    out = []
    for c in comps:
        _, h, v, _ = parts[c]
        rows, cols, _, _, base = grids[c]
        out.append(base + np.arange(rows * cols).reshape(rows // v, v, cols // h, h).transpose(0, 2, 1, 3).reshape(-1, h * v))
    return np.concatenate(out, axis=1)


class _Data:
    """Entropy-coded data of a batch: 64 bits from each byte on, stuffing removed, and the restart markers."""

    def __init__(self, data: np.ndarray):
        full = np.flatnonzero(data[:-1] == 255)
        after = data[full + 1]
        stuffed = np.zeros(len(data), bool)
        stuffed[full[after == 0] + 1] = True
        self.marks = full[(after >= 0xD0) & (after <= 0xD7)]
        self.place = np.arange(len(data)) - np.cumsum(stuffed)
        plain = np.concatenate([data[~stuffed], np.zeros(16, np.uint8)]).astype(np.uint64)
        self.words = plain[: len(plain) - 8].copy()
        for j in range(1, 8):
            self.words <<= np.uint64(8)
            self.words |= plain[j : len(plain) - 8 + j]


class _Lanes:
    """Restart intervals of one scan of many images; position in bits of each."""

    def __init__(self, data: _Data, images: list[tuple[Image, int]], number: int):
        self.comps, self.lo, self.hi, self.high, self.low, restart, self.used = images[0][0].scans[number][0]
        starts = np.array([x.scans[number][1] + offset for x, offset in images])
        ends = np.array([x.scans[number][2] + offset for x, offset in images])
        orders = [x.base + _places(tuple(x.grids), tuple(x.parts), self.comps) for x, _ in images]
        units = np.array([len(o) for o in orders])
        step = restart or int(units.max())
        lanes = -(-units // step)
        lower = np.searchsorted(data.marks, starts)
        if (np.searchsorted(data.marks, ends) - lower + 1 != lanes).any():
            raise ValueError("restart markers don't fit the image")
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(starts, lanes)
        if len(data.marks):
            at = np.where(nth > 0, data.marks[np.minimum(np.repeat(lower, lanes) + nth - 1, len(data.marks) - 1)] + 2, at)
        self.at = data.place[at] * 8
        self.words = data.words
        self.order = np.concatenate(orders)
        self.count = np.minimum(step, np.repeat(units, lanes) - nth * step)
        self.first = np.cumsum(self.count) - self.count

    def peek(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] << (at & 7).astype(np.uint64)


def _extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)


def _symbol(word: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = lookup[(word >> np.uint64(48)).astype(np.int64)]
    if not found.all():
        raise ValueError("no such Huffman code")
    return found & 255, found >> 8


def _bits(word: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    return ((word << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _dc_scan(lanes: _Lanes, coefs: np.ndarray, parts: list) -> None:
    sizes = [parts[c][1] * parts[c][2] if len(lanes.comps) > 1 else 1 for c in lanes.comps]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    lookups = {} if lanes.high else {i: u.lookup for i, u in enumerate(lanes.used)}
    at, before = lanes.at.copy(), np.zeros((len(lanes.at), len(sizes)), np.int64)
    for t in range(int(lanes.count.max())):
        live = np.flatnonzero(lanes.count > t)
        for j, c in enumerate(owner):
            block = lanes.order[lanes.first[live] + t, j]
            word = lanes.peek(at[live])
            if lanes.high:
                coefs[block, 0] |= ((word >> np.uint64(63)).astype(np.int64) << lanes.low).astype(coefs.dtype)
                at[live] += 1
            else:
                size, length = _symbol(word, lookups[c])
                before[live, c] += _extended(_bits(word, length, size), size)
                coefs[block, 0] = before[live, c] << lanes.low
                at[live] += length + size


def _ac_first_scan(lanes: _Lanes, coefs: np.ndarray) -> None:
    lookup, flat = lanes.used[0].lookup, coefs.reshape(-1)
    at, first, count = lanes.at, lanes.first, lanes.count
    i, k = np.zeros(len(at), np.int64), np.full(len(at), lanes.lo)
    order = lanes.order[:, 0]
    while len(at):
        word = lanes.peek(at)
        symbol, length = _symbol(word, lookup)
        run, size = symbol >> 4, symbol & 15
        end = (size == 0) & (run < 15)
        n = np.where(end, run, size)
        bits = _bits(word, length, n)
        at = at + length + n
        k = k + np.where(end, 0, run)
        some = size > 0
        if (k > lanes.hi).any():
            raise ValueError("a run leaves its band")
        flat[order[first + i][some] * 64 + k[some]] = _extended(bits[some], size[some]) << lanes.low
        k += 1
        over = end | (k > lanes.hi)
        i = i + np.where(end, (1 << run) + bits, over)
        k[over] = lanes.lo
        live = i < count
        if not live.all():
            at, first, count, i, k = at[live], first[live], count[live], i[live], k[live]


def _ac_refine_scan(lanes: _Lanes, coefs: np.ndarray) -> None:
    lookup, flat, one = lanes.used[0].lookup, coefs.reshape(-1), 1 << lanes.low
    band = np.arange(lanes.lo, lanes.hi + 1)
    at, first, count = lanes.at, lanes.first, lanes.count
    n = len(at)
    i, k, run, new, ended, need = np.zeros(n, np.int64), np.full(n, lanes.lo), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    order = lanes.order[:, 0]
    while len(at):
        ask = np.flatnonzero(need & (ended == 0))
        if len(ask):
            word = lanes.peek(at[ask])
            symbol, length = _symbol(word, lookup)
            r, size = symbol >> 4, symbol & 15
            end = (size == 0) & (r < 15)
            extra = np.where(end, r, size)
            bits = _bits(word, length, extra)
            at[ask] += length + extra
            ended[ask] = np.where(end, (1 << r) + bits, 0)
            run[ask] = r
            new[ask] = np.where(size > 0, np.where(bits > 0, one, -one), 0)
            need[ask] = False
        whole = np.flatnonzero((ended > 0) & (k == lanes.lo))
        if len(whole):  # nothing but correction bits in these blocks: all of a block at once
            where = (order[first[whole] + i[whole]] * 64)[:, None] + band
            c = flat[where]
            known = c != 0
            passed = np.cumsum(known, axis=1)
            from_bit = at[whole, None] + passed - known
            bit = lanes.words[from_bit >> 3] << (from_bit & 7).astype(np.uint64) >> np.uint64(63)
            flat[where] = c + np.where(known, bit.astype(np.int16) * np.int16(one) * np.sign(c), 0).astype(np.int16)
            at[whole] += passed[:, -1]
            ended[whole] -= 1
            i[whole] += 1
            need[whole] = True
            if len(whole) == len(at):
                live = i < count
                if not live.all():
                    at, first, count, i, k, run, new, ended, need = (x[live] for x in (at, first, count, i, k, run, new, ended, need))
                continue
            live = np.ones(len(at), bool)
            live[whole] = False
            rest = np.flatnonzero(live)
        else:
            rest = slice(None)
        _refine_step(lanes, flat, one, order, rest, at, first, i, k, run, new, ended, need)
        live = i < count
        if not live.all():
            at, first, count, i, k, run, new, ended, need = (x[live] for x in (at, first, count, i, k, run, new, ended, need))


def _refine_step(lanes: _Lanes, flat: np.ndarray, one: int, order: np.ndarray, rest, at, first, i, k, run, new, ended, need) -> None:
    """One coefficient of each lane in rest; the state arrays are changed in place."""
    where = order[first[rest] + i[rest]] * 64 + k[rest]
    c = flat[where].astype(np.int64)
    known = c != 0
    bit = (lanes.peek(at[rest]) >> np.uint64(63)).astype(np.int64)
    c += np.where(known, bit * one * np.sign(c), 0)
    at[rest] += known
    open_zero = ~known & (ended[rest] == 0)
    here = open_zero & (run[rest] == 0)
    flat[where] = np.where(here, new[rest], c)
    run[rest] -= open_zero & ~here
    over = k[rest] == lanes.hi
    k[rest] = np.where(over, lanes.lo, k[rest] + 1)
    i[rest] += over
    ended[rest] = np.maximum(ended[rest] - over, 0)
    need[rest] |= here | over


def decode_coefficients(tiles: list[tuple[bytes, Image]]) -> np.ndarray:
    """The coefficients (block, zigzag place) of all images; each image's ``base`` tells where its blocks begin."""
    groups, base, offset = defaultdict(list), 0, 0
    for data, image in tiles:
        base = _lay_out(image, base)
        groups[image.key()].append((image, offset))
        offset += len(data)
    coefs = np.zeros((base, 64), np.int16)
    data = _Data(np.frombuffer(b"".join(d for d, _ in tiles), np.uint8))
    for same in groups.values():
        for number, (signature, _, _) in enumerate(same[0][0].scans):
            lanes = _Lanes(data, same, number)
            if signature[1] == 0:
                _dc_scan(lanes, coefs, same[0][0].parts)
            elif signature[3]:
                _ac_refine_scan(lanes, coefs)
            else:
                _ac_first_scan(lanes, coefs)
    return coefs


#: The inverse transform's matrix in 15-bit fixed point. Held as floats, all products and sums are whole numbers below
#: 2**53, so results are exact and don't depend on the order in which a matrix product adds them.
_COS = np.round(np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.125), 0.5)[:, None] * 32768)


def samples(coefs: np.ndarray, quantisation: np.ndarray) -> np.ndarray:
    """(blocks, zigzag place) -> (blocks, 8, 8) samples 0 to 255."""
    block = np.zeros((len(coefs), 64))
    block[:, ZIGZAG] = coefs * quantisation
    rows = (block.reshape(-1, 8) @ _COS).reshape(-1, 8, 8).transpose(0, 2, 1)
    out = (np.ascontiguousarray(rows).reshape(-1, 8) @ _COS).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.floor((out + 2.0**29) / 2.0**30) + 128, 0, 255).astype(np.uint8)


def all_samples(images: list[Image], coefs: np.ndarray) -> np.ndarray:
    """Samples of all blocks; blocks with the same quantisation table are transformed together."""
    by_table, out = defaultdict(list), np.empty((len(coefs), 8, 8), np.uint8)
    for x in images:
        for (_, _, _, tq), (rows, cols, _, _, first) in zip(x.parts, x.grids, strict=True):
            by_table[x.tables[tq].tobytes()].append((x.base + first, x.base + first + rows * cols))
    for table_bytes, ranges in by_table.items():
        which = slice(None) if len(by_table) == 1 else np.concatenate([np.arange(a, b) for a, b in ranges])
        out[which] = samples(coefs[which], np.frombuffer(table_bytes, np.int64))
    return out


def rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """The full-resolution tensor (height, width, 3); chroma samples are repeated over what they stand for."""
    hm, vm = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    planes = []
    for (_, h, v, _), (rows, cols, _, _, first) in zip(image.parts, image.grids, strict=True):
        s = blocks[image.base + first : image.base + first + rows * cols]
        plane = s.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        planes.append(plane)
    whole = lambda c, p: p.repeat(vm // image.parts[c][2], axis=0).repeat(hm // image.parts[c][1], axis=1)[: image.height, : image.width]
    y = whole(0, planes[0])
    if len(planes) == 1:
        return np.repeat(y[:, :, None], 3, axis=2)
    y, cb, cr = y.astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    if image.parts[1][1:3] == image.parts[2][1:3]:  # both planes have one grid: mix them before they are repeated
        out[:, :, 0] = np.clip(y + whole(2, (91881 * cr + 32768) >> 16), 0, 255)
        out[:, :, 1] = np.clip(y - whole(1, (22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
        out[:, :, 2] = np.clip(y + whole(1, (116130 * cb + 32768) >> 16), 0, 255)
        return out
    cb, cr = whole(1, cb), whole(2, cr)
    out[:, :, 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
    out[:, :, 1] = np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
    out[:, :, 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
    return out


def payload_of(image: Image, coefs: np.ndarray) -> bytes:
    return (coefs[image.base : image.base + image.length // 64] + 128).astype(np.uint8).tobytes()


# ------------------------------------------------------------------------------------------------------------ columns
def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """One stream for each payload, of any length that is a positive multiple of 64."""
    tiles = [(i, p[a : a + TILE]) for i, p in enumerate(payloads) for a in range(0, len(p), TILE)]
    out = [[] for _ in payloads]
    for a, b in slices([len(t) for _, t in tiles], PASS):
        for (i, _), data in zip(tiles[a:b], encode([t for _, t in tiles[a:b]]), strict=True):
            out[i].append(data)
    return [b"".join(x) for x in out]


def split_stream(stream: bytes) -> list[tuple[bytes, Image]]:
    """The images of a stream, one after the other, their headers parsed."""
    out, at = [], 0
    while at < len(stream):
        image, end = parse(stream, at)
        image.scans = [(k, a - at, b - at) for k, a, b in image.scans]
        out.append((stream[at:end], image))
        at = end
    return out


def read_all(streams: list[bytes]) -> list[tuple]:
    """(payload length, sha256, crc32 of the last 32 bytes, feature) read back from each stream.

    The feature tells the number of pixels, the mean of each channel and a checksum of the RGB tensors.
    """
    tiles = [(i, t) for i, s in enumerate(streams) for t in split_stream(s)]
    state = [[0, hashlib.sha256(), b"", np.zeros(3, np.int64), 0, 0] for _ in streams]
    for a, b in slices([len(t[0]) for _, t in tiles], PASS):
        coefs = decode_coefficients([t for _, t in tiles[a:b]])
        blocks = all_samples([x for _, (_, x) in tiles[a:b]], coefs)
        for i, (_, image) in tiles[a:b]:
            s, payload, tensor = state[i], payload_of(image, coefs), rgb(image, blocks)
            s[0] += len(payload)
            s[1].update(payload)
            s[2] = (s[2] + payload[-32:])[-32:]
            s[3] = s[3] + tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64)
            s[4] += tensor.shape[0] * tensor.shape[1]
            s[5] = zlib.crc32(tensor, s[5])
    return [(n, h.hexdigest(), zlib.crc32(tail), f"{pixels}:{','.join(f'{x / pixels:.3f}' for x in sums)}:{check:08x}") for n, h, tail, sums, pixels, check in state]


def tensors(stream: bytes) -> list[np.ndarray]:
    out = []
    for tile in split_stream(stream):
        coefs = decode_coefficients([tile])
        out.append(rgb(tile[1], all_samples([tile[1]], coefs)))
    return out


def _batches(values: list[bytes]) -> Iterator[tuple[int, int]]:
    return iter(slices([len(v) for v in values], PASS))


def encode_column(payload: Column) -> Column:
    """Binary payloads -> progressive JPEG streams. The payload is padded to a multiple of UNIT; null counts as empty."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for payloads in batches:
            own = [padded(p or b"") for p in payloads]
            yield pd.Series([x for a, b in _batches(own) for x in encode_all(own[a:b])], dtype=object)

    return of(payload)


def tensor_column(stream: Column) -> Column:
    """Progressive JPEG streams -> array of RGB tensors (height, width, bytes in rows); a null stream has none."""

    @F.pandas_udf("array<struct<height:int,width:int,rgb:binary>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for streams in batches:
            yield pd.Series([[{"height": t.shape[0], "width": t.shape[1], "rgb": t.tobytes()} for t in (tensors(s) if s is not None else [])] for s in streams], dtype=object)

    return of(stream)


_DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest_column(payload: Column) -> Column:
    """Store each payload as a stream, read the stream back, and tell what was read; streams stay in the worker."""

    @F.pandas_udf(_DIGEST)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payloads in batches:
            own, rows = [padded(p or b"") for p in payloads], []
            for a, b in _batches(own):
                streams = encode_all(own[a:b])
                for stream, (n, sha, tail, feature) in zip(streams, read_all(streams), strict=True):
                    rows.append((n, sha, tail, len(stream), hashlib.sha256(stream).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DIGEST.split(", ")])

    return of(payload)


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(utf8(F.col("text")), F.lit(b"")).alias("b"))
    return docs.select("doc_id", F.length("b").cast("long").alias("n_bytes"), digest_column(F.col("b")).alias("d")).select("doc_id", "n_bytes", "d.*")
