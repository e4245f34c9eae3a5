"""Lossless WebP (VP8L) in numpy: a decoder for the whole format and an encoder for 8-bit sample planes.

The decoder reads the headers of each file one by one (transforms, prefix codes, colour cache, entropy image) and
then decodes the pixels of many files in lockstep: step t yields pixel t of every file that is longer than t, so
that a step costs a few array operations however many files there are. Prefix codes, back-references, the colour
cache and prefix-code groups are handled there; the predictor, cross-colour, subtract-green and palette
transforms are inverted afterwards.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

from . import blocks as B

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Neighbours (x to the left, y up) that distance codes 1 to 120 stand for.
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_CODES, DISTANCE_CODES = 24, 40


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        lo = self.at >> 3
        value = int.from_bytes(self.data[lo : lo + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image data end too early")
        return value


@cache
def _reversals() -> list[int]:
    """Each number below 2**15 with its fifteen bits the other way round."""
    out = [0]
    for k in range(14, -1, -1):
        out += [x | 1 << k for x in out]
    return out


def _coded(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Symbol, bit-reversed canonical code and its length, of the symbols that have a code."""
    turned, code, before, out = _reversals(), 0, 0, []
    for n, s in sorted([(n, s) for s, n in enumerate(lengths) if n]):
        code <<= n - before
        out.append((s, turned[code & 0x7FFF] >> 15 - n, n))
        code, before = code + 1, n
    return out


def canonical(lengths: list[int]) -> list[int]:
    """Bit-reversed canonical codes of the given lengths (0: no code)."""
    out = [0] * len(lengths)
    for s, code, _ in _coded(lengths):
        out[s] = code
    return out


@cache
def _lone(symbol: int) -> tuple[np.ndarray, int]:
    return np.array([symbol << 4], np.uint32), 0


def lookup(lengths: list[int]) -> tuple[np.ndarray, int]:
    """Table from the next ``bits`` bits to ``symbol << 4 | length``; a lone symbol takes no bits."""
    used = _coded(lengths)
    if len(used) == 1:
        return _lone(used[0][0])
    if not used or sum(1 << 15 - n for _, _, n in used) != 1 << 15:
        raise ValueError("an incomplete prefix code")
    bits = used[-1][2]
    table = np.zeros(1 << bits, np.uint32)
    for s, code, n in used:
        table[code :: 1 << n] = s << 4 | n
    return table, bits


def _read_code(src: Bits, size: int) -> tuple[np.ndarray, int]:
    lengths = [0] * size
    if src.read(1):
        two = src.read(1)
        first = src.read(8 if src.read(1) else 1)
        if not two:
            if first >= size:
                raise ValueError("a symbol past the alphabet")
            return _lone(first)
        lengths[first] = lengths[src.read(8)] = 1
        return lookup(lengths)
    of_lengths = [0] * 19
    for i in range(4 + src.read(4)):
        of_lengths[CODE_LENGTH_ORDER[i]] = src.read(3)
    code = lookup(of_lengths)
    left = 2 + src.read(2 + 2 * src.read(3)) if src.read(1) else size
    at, last = 0, 8
    table, mask, data, bit = code[0].tolist(), (1 << code[1]) - 1, src.data, src.at
    while at < size and left:
        left -= 1
        lo = bit >> 3
        window = int.from_bytes(data[lo : lo + 4], "little") >> (bit & 7)
        entry = table[window & mask]
        s, n = entry >> 4, entry & 15
        bit += n
        if s < 16:
            if s:
                lengths[at] = last = s
            at += 1
            continue
        more = (2, 3, 7)[s - 16]
        n = (window >> n & ((1 << more) - 1)) + (11 if s == 18 else 3)
        bit += more
        if at + n > size:
            raise ValueError("code lengths past the alphabet")
        if s == 16:
            lengths[at : at + n] = [last] * n
        at += n
    src.at = bit
    if bit > 8 * len(data):
        raise ValueError("the image data end too early")
    return lookup(lengths)


class Coded:
    """Header of an entropy-coded image: its prefix-code groups, and where its pixels' bits begin."""

    def __init__(self, src: Bits, width: int, height: int, main: bool) -> None:
        self.width, self.height = width, height
        self.cache_bits = src.read(4) if src.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("too large a colour cache")
        self.meta: np.ndarray | None = None
        self.meta_bits = groups = 0
        if main and src.read(1):
            self.meta_bits = src.read(3) + 2
            w, h = (width + (1 << self.meta_bits) - 1) >> self.meta_bits, (height + (1 << self.meta_bits) - 1) >> self.meta_bits
            self.meta = (_sub_image(src, w, h) >> 8 & 0xFFFF).astype(np.int64).reshape(h, w)
            groups = int(self.meta.max())
        sizes = (256 + LENGTH_CODES + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
        self.codes = [[_read_code(src, n) for n in sizes] for _ in range(groups + 1)]
        self.at = src.at


def _sub_image(src: Bits, width: int, height: int) -> np.ndarray:
    head = Coded(src, width, height, False)
    (pixels,), ends = _pixels([head], np.frombuffer(src.data, np.uint8), np.array([0]), np.array([len(src.data)]))
    src.at = int(ends[0])
    return pixels


class File:
    """Everything of a file before its pixels."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L" or data[20] != 0x2F:
            raise ValueError("not a lossless WebP file")
        self.data = data[20 : 20 + struct.unpack("<I", data[16:20])[0]]
        src = Bits(self.data, 8)
        self.width, self.height = src.read(14) + 1, src.read(14) + 1
        self.alpha = src.read(1)
        if src.read(3):
            raise ValueError("an unknown version")
        self.transforms: list[tuple] = []
        width = self.width
        while src.read(1):
            kind = src.read(2)
            if kind in (PREDICTOR, CROSS_COLOUR):
                bits = src.read(3) + 2
                w, h = (width + (1 << bits) - 1) >> bits, (self.height + (1 << bits) - 1) >> bits
                self.transforms.append((kind, bits, _sub_image(src, w, h).reshape(h, w), width))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind,))
            else:
                size = src.read(8) + 1
                table = _sub_image(src, size, 1)
                for shift in (0, 8, 16, 24):
                    lane = np.cumsum(table >> shift & 0xFF) & 0xFF
                    table = table & ~(np.uint32(0xFF) << np.uint32(shift)) | lane.astype(np.uint32) << np.uint32(shift)
                packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
                self.transforms.append((kind, packed, table, width))
                width = (width + (1 << packed) - 1) >> packed
        self.coded = Coded(src, width, self.height, True)


def _extra(symbol: np.ndarray, bits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of a length or distance symbol, with the bits that follow it; and the next bit's place."""
    n = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    more = (bits[at >> 3] >> (at & 7)) & ((1 << n) - 1)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << n) + more + 1), at + n


def _pixels(heads: list[Coded], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """ARGB pixels of images whose bits lie in ``data`` from byte ``starts`` on, and the bit after each image's last."""
    matrix, order, sizes, ends = _lockstep(heads, data, starts, ends)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(heads)
    for k, i in enumerate(order):
        out[i] = matrix[: sizes[k], k].copy()
    back = np.empty_like(ends)
    back[order] = ends
    return out, back - 8 * starts


def _lockstep(heads: list[Coded], data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pixels (row t has pixel t of each image, longest images first), the images' order, their sizes and last bits."""
    sizes = np.array([h.width * h.height for h in heads])
    order = np.argsort(-sizes, kind="stable")
    sizes, steps = sizes[order], int(sizes.max(initial=0))
    padded = np.zeros(len(data) + 16, np.uint32)
    padded[: len(data)] = data
    bits = padded[:-8].copy()
    for k in range(1, 4):
        bits |= padded[k : len(bits) + k] << np.uint32(8 * k)
    # tables of all codes on end, and where each image's groups begin
    tables: list[np.ndarray] = []
    base: dict[int, int] = {}
    total, lanes, first, seen = 0, [], [], {}
    for i in order:
        h = heads[i]
        if id(h.codes) not in seen:
            seen[id(h.codes)] = len(lanes)
            for codes in h.codes:
                lane = []
                for table, n in codes:
                    if id(table) not in base:
                        base[id(table)] = total
                        tables.append(table)
                        total += len(table)
                    lane += [base[id(table)], (1 << n) - 1]
                lanes.append(lane)
        first.append(seen[id(h.codes)])
    table, spec, group = np.concatenate(tables).astype(np.int64), np.array(lanes, np.int64), np.array(first, np.int64)
    fixed = bool((spec[:, [3, 5, 7]] == 0).all())  # red, blue and alpha take no bits
    at = 8 * starts[order] + np.array([heads[i].at for i in order])
    stop = 8 * stops[order]
    widths = np.array([heads[i].width for i in order])
    metas = [(k, heads[i]) for k, i in enumerate(order) if heads[i].meta is not None]
    caches = np.array([heads[i].cache_bits for i in order])
    cached = bool(caches.any())
    store = np.zeros((len(order), 1 << int(caches.max(initial=0))), np.int64) if cached else None
    out = np.zeros((steps, len(order)), np.uint32)
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")
    near = np.array(NEIGHBOURS)
    wake: dict[int, list[int]] = {}  # images whose back-reference ends before a step

    def symbol(k: int, rows: np.ndarray) -> np.ndarray:
        b, g = at[rows], group[rows]
        e = table[spec[g, 2 * k] + (bits[b >> 3] >> (b & 7) & spec[g, 2 * k + 1])]
        at[rows] = b + (e & 15)
        return e >> 4

    def remember(row: int, lo: int, hi: int) -> None:
        pixels = out[lo:hi, row].astype(np.int64)
        store[row, (pixels * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - caches[row])] = pixels

    act = np.arange(len(order))
    away = np.zeros(len(order), bool)
    b = at.copy()
    fresh = True
    for t in range(steps):
        n = int(alive[t])
        if t in wake or len(act) and act[-1] >= n:
            at[act] = b
            fresh = True
            act = np.sort(np.concatenate([act, np.array(wake.pop(t, []), np.int64)]))
            act = act[: np.searchsorted(act, n)]
            b = at[act]
        if not len(act):
            continue
        if metas:
            at[act] = b
            for k, h in metas:
                if k < n:
                    y, x = divmod(t, h.width)
                    group[k] = first[k] + h.meta[y >> h.meta_bits, x >> h.meta_bits]
            fresh = True
        if fresh:
            b, lane, fresh = at[act], spec[group[act]], False
            green, mask = lane[:, 0].copy(), lane[:, 1].copy()
            rest = (table[lane[:, 2]] >> 4 << 16 | table[lane[:, 4]] >> 4 | table[lane[:, 6]] >> 4 << 24) if fixed else None
        e = table[green + (bits[b >> 3] >> (b & 7) & mask)]
        b += e & 15
        e >>= 4
        plain = int(e.max()) < 256
        if fixed:
            out[t, act] = rest | e << 8
        else:
            at[act] = b
            literal = e < 256
            r = act[literal]
            red, blue, alpha = (symbol(k, r) for k in (1, 2, 3))
            out[t, r] = alpha << 24 | red << 16 | e[literal] << 8 | blue
            b = at[act]
        gone: list[int] = []
        if not plain:
            at[act] = b
            special = np.flatnonzero(e >= 256)
            ref = special[e[special] < 256 + LENGTH_CODES]
            r = act[ref]
            if len(r):
                length, at[r] = _extra(e[ref] - 256, bits, at[r])
                d, at[r] = _extra(symbol(4, r), bits, at[r])
                xy = near[np.minimum(d, len(near)) - 1]
                d = np.where(d <= len(near), np.maximum(1, xy[:, 0] + xy[:, 1] * widths[r]), d - len(near))
                if (d > t).any() or (length > sizes[r] - t).any():
                    raise ValueError("a back-reference past the image")
                for row, m, back in zip(r.tolist(), length.tolist(), d.tolist(), strict=True):
                    out[t : t + m, row] = out[t - back : t - back + m, row] if back >= m else np.resize(out[t - back : t, row], m)
                    if cached and caches[row]:
                        remember(row, t, t + m)
                    if m > 1:
                        gone.append(row)
                        away[row] = True
                        if t + m < sizes[row]:
                            wake.setdefault(t + m, []).append(row)
            if cached:
                old = e >= 256 + LENGTH_CODES
                out[t, act[old]] = store[act[old], e[old] - 256 - LENGTH_CODES]
            b = at[act]
        if cached:
            r = act[(caches[act] > 0)]
            argb = out[t, r].astype(np.int64)
            if gone:  # their pixels are in the cache already, up to the last
                keep = ~away[r]
                r, argb = r[keep], argb[keep]
            store[r, (argb * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - caches[r])] = argb
        if gone:
            at[act] = b
            keep = ~away[act]
            act, b = act[keep], b[keep]
            if not metas:
                green, mask, rest = green[keep], mask[keep], rest[keep] if fixed else None
            away[gone] = False
    at[act] = b
    if (at > stop).any():
        raise ValueError("the image data end too early")
    return out, order, sizes, at


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predicted channels from the neighbours L, T, TR and TL."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])
    if mode == 11:
        ahead = left + top - corner
        return left if np.abs(ahead - left).sum() < np.abs(ahead - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mid = _average(left, top)
        return np.clip(mid + ((mid - corner) / 2).astype(np.int64), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: _average(_average(left, right), top), 6: lambda: _average(left, corner),
        7: lambda: _average(left, top), 8: lambda: _average(corner, top), 9: lambda: _average(top, right), 10: lambda: _average(_average(left, corner), _average(top, right)),
    }[mode]()


def channels(argb: np.ndarray) -> np.ndarray:
    """Blue, green, red and alpha on the last axis."""
    return np.stack([argb >> s & 0xFF for s in (0, 8, 16, 24)], -1).astype(np.int64)


def joined(lanes: np.ndarray) -> np.ndarray:
    lanes = (lanes & 0xFF).astype(np.uint32)
    return lanes[..., 0] | lanes[..., 1] << 8 | lanes[..., 2] << 16 | lanes[..., 3] << 24


def invert(transform: tuple, image: np.ndarray) -> np.ndarray:
    """Undo one transform on an image of shape (height, width)."""
    kind = transform[0]
    if kind == SUBTRACT_GREEN:
        green = image >> 8 & 0xFF
        return image & np.uint32(0xFF00FF00) | (image & 0xFF) + green & 0xFF | ((image >> 16 & 0xFF) + green & 0xFF) << 16
    if kind == CROSS_COLOUR:
        _, bits, blocks, _ = transform
        lanes = channels(image)
        sign = lambda x: (x & 0xFF ^ 0x80) - 0x80
        factor = sign(channels(np.repeat(np.repeat(blocks, 1 << bits, 0), 1 << bits, 1)[: image.shape[0], : image.shape[1]]))
        green = sign(lanes[..., 1])
        lanes[..., 2] += factor[..., 0] * green >> 5
        lanes[..., 0] += (factor[..., 1] * green >> 5) + (factor[..., 2] * sign(lanes[..., 2]) >> 5)
        return joined(lanes)
    if kind == PALETTE:
        _, packed, table, width = transform
        index = image >> 8 & 0xFF
        if packed:
            each = 8 >> packed
            index = (index[..., None] >> (np.arange(1 << packed, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(len(image), -1)[:, :width]
        return np.where(index < len(table), table[np.minimum(index, len(table) - 1)], np.uint32(0))
    _, bits, blocks, _ = transform
    lanes = channels(image)
    height, width = image.shape
    mode = (blocks >> 8 & 0xF).astype(int)
    lanes[0, 0] = lanes[0, 0] + (0, 0, 0, 255) & 0xFF
    if width > 1:
        lanes[0] = np.cumsum(lanes[0], 0) & 0xFF
    for y in range(1, height):
        above = np.concatenate([lanes[y - 1], lanes[y, :1]])
        lanes[y, 0] = lanes[y, 0] + above[0] & 0xFF
        above[width] = lanes[y, 0]
        for x in range(1, width):
            m = mode[y >> bits, x >> bits]
            lanes[y, x] = lanes[y, x] + _predict(m, lanes[y, x - 1], above[x], above[x + 1], above[x - 1]) & 0xFF
    return joined(lanes)


def decode(files: list[bytes]) -> list[np.ndarray]:
    """ARGB images, of shape (height, width), of any lossless WebP files."""
    parsed = [File(f) for f in files]
    sizes = np.array([len(f.data) for f in parsed])
    starts = np.cumsum(sizes) - sizes
    pixels, _ = _pixels([f.coded for f in parsed], np.frombuffer(b"".join(f.data for f in parsed), np.uint8), starts, starts + sizes) if files else ([], None)
    out = []
    for f, flat in zip(parsed, pixels, strict=True):
        image = flat.reshape(f.coded.height, f.coded.width)
        for t in reversed(f.transforms):
            image = invert(t, image)
        out.append(image)
    return out


# ---- sample planes: grey images of 48 columns and at most 48 rows, one byte a pixel

SIDE = 48
UNIT = 576  # twelve rows
_HEAD = 25  # bytes before the transforms

#: Longest code of a plane, which bounds a file's table in the decoder; bytes that a match begins with, and the shortest match.
LIMIT, GRAM, SHORTEST = 10, 8, 8


def huffman(weights: list[int], limit: int = 15) -> list[int]:
    """Code lengths for the weights, none over the limit (small weights are raised until that holds)."""
    lengths = [0] * len(weights)
    leaves = sorted((w, i) for i, w in enumerate(weights) if w)
    n, floor = len(leaves), 1
    if n < 2:
        for _, i in leaves:
            lengths[i] = 1
        return lengths
    while True:
        # leaves by weight and inner nodes as they are made are two queues in order
        total = [max(w, floor) for w, _ in leaves]
        above = [0] * (2 * n - 1)
        leaf, node = 0, n
        for new in range(n, 2 * n - 1):
            both = 0
            for _ in range(2):
                if leaf < n and (node >= new or total[leaf] <= total[node]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, node = node, node + 1
                above[k] = new
                both += total[k]
            total.append(both)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:n]) <= limit:
            for (_, i), d in zip(leaves, depth[:n], strict=True):
                lengths[i] = d
            return lengths
        floor *= 2


class Writer:
    def __init__(self) -> None:
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def code(self, lengths: list[int]) -> None:
        """Write code lengths: a simple code for one symbol or two, else with runs of zeros."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) <= 2 and max(used, default=0) < 256:
            used = used or [0]
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            self.put(1, 1)
            for s in used:
                self.put(s, 8)
            return
        self.put(0, 1)
        runs: list[tuple[int, int, int]] = []  # symbol, what follows it, and its bits
        last = -1
        for s in [*used, len(lengths)]:
            zeros = s - last - 1
            while zeros > 2:
                n = min(zeros, 138)
                runs.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
                zeros -= n
            runs += [(0, 0, 0)] * zeros
            if s < len(lengths):
                runs.append((lengths[s], 0, 0))
            last = s
        counts = [0] * 19
        for s, _, _ in runs:
            counts[s] += 1
        own = huffman(counts, 7)
        self.put(15, 4)
        for s in CODE_LENGTH_ORDER:
            self.put(own[s], 3)
        codes = canonical(own)
        if sum(map(bool, own)) == 1:
            own = [0] * 19  # a lone symbol takes no bits
        self.put(0, 1)
        value = at = 0
        for s, more, n in runs:
            value |= (codes[s] | more << own[s]) << at
            at += own[s] + n
        self.put(value, at)

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.at + 7) // 8, "little")


def _length_symbol(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number for run lengths."""
    v = np.maximum(n - 1, 0)
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    second = v >> np.maximum(high - 1, 0) & 1
    small = v < 2
    count = np.where(small, 0, high - 1)
    return np.where(small, v, 2 * high + second), np.where(small, 0, v & ((1 << count) - 1)), count


@cache
def _distances() -> np.ndarray:
    """Distance code of each distance within a plane: the first neighbour's that lies so far back, or the plain one."""
    out = np.arange(SIDE * SIDE + 1) + len(NEIGHBOURS)
    for code, (x, y) in reversed(list(enumerate(NEIGHBOURS, 1))):
        if x + y * SIDE > 0:
            out[x + y * SIDE] = code
    return out


def _matches(samples: np.ndarray, ends: np.ndarray, plane: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, length and distance of the back-references, in order: where GRAM bytes occurred before in the plane, as far as they go."""
    n = len(samples)
    padded = np.zeros(n + GRAM, np.uint64)
    padded[:n] = samples
    gram = padded[:n].copy()
    for k in range(1, GRAM):
        gram |= padded[k : n + k] << np.uint64(8 * k)
    whole = np.flatnonzero(np.arange(n) + GRAM <= (ends - np.maximum(tails - 1, 0))[plane])  # the alike bytes at the end are a reference anyway
    place = np.uint64(max(1, n).bit_length())
    keys = B.mix(gram[whole] ^ (plane[whole].astype(np.uint64) << np.uint64(40))) >> place << place | whole.astype(np.uint64)
    keys.sort()
    at = (keys & np.uint64((1 << int(place)) - 1)).astype(np.int64)
    same = (gram[at[1:]] == gram[at[:-1]]) & (plane[at[1:]] == plane[at[:-1]])
    back = np.zeros(n, np.int64)
    back[at[1:][same]] = (at[1:] - at[:-1])[same]
    some = np.flatnonzero(back)
    first = np.flatnonzero((np.diff(some, prepend=-2) != 1) | (np.diff(back[some], prepend=0) != 0))
    start, distance = some[first], back[some[first]]
    length = np.diff(np.append(first, len(some))) + GRAM - 1
    long = np.flatnonzero(tails > 1)
    start, distance, length = (np.concatenate(x) for x in ((start, ends[long] - tails[long] + 1), (distance, np.ones(len(long), np.int64)), (length, tails[long] - 1)))
    order = np.argsort(start, kind="stable")
    out, end = [], 0
    for at_, m, d in zip(start[order].tolist(), length[order].tolist(), distance[order].tolist(), strict=True):
        lo = max(at_, end)
        if at_ + m - lo >= SHORTEST or lo == at_ and d == 1:
            end = at_ + m
            out.append((lo, end - lo, d))
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _fitted(counts: list[int]) -> tuple[list[int], np.ndarray]:
    """Code lengths of the symbols that occur, and code << 4 | length of each; a lone symbol takes no bits."""
    used = [s for s, n in enumerate(counts) if n]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths, np.zeros(len(counts), np.uint64)
    for s, n in zip(used, huffman([counts[s] for s in used], LIMIT), strict=True):
        lengths[s] = n
    return lengths, np.array(canonical(lengths), np.uint64) << np.uint64(4) | np.array(lengths, np.uint64)


def encode_planes(samples: np.ndarray, sizes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """WebP files, on end, and their sizes: one for each run of ``sizes`` bytes (multiples of 48, at most 48 * 48).

    Each file has prefix codes fitted to its own literals, lengths and distances. The last ``tails`` bytes of a run are
    alike, so that no search is needed there.
    """
    ends = np.cumsum(sizes)
    plane = np.repeat(np.arange(len(sizes)), sizes)
    ref, length, distance = _matches(samples, ends, plane, tails)
    size_symbol, size_extra, size_bits = _length_symbol(length)
    far_symbol, far_extra, far_bits = _length_symbol(_distances()[distance])
    symbol = samples.astype(np.int64)
    symbol[ref] = 256 + size_symbol
    kept = np.ones(len(samples), bool)
    kept[np.repeat(ref + 1, length - 1) + _ramp(length - 1)] = False
    width = 256 + LENGTH_CODES
    index = plane * width + symbol
    counts = np.bincount(index[kept], minlength=width * len(sizes)).reshape(-1, width)
    far_index = plane[ref] * DISTANCE_CODES + far_symbol
    far_counts = np.bincount(far_index, minlength=DISTANCE_CODES * len(sizes)).reshape(-1, DISTANCE_CODES)
    heads, codes, far_codes = [], [], []
    for own, far in zip(counts.tolist(), far_counts.tolist(), strict=True):
        lengths, code = _fitted(own)
        far_lengths, far_code = _fitted(far)
        head = Writer()
        head.put(1 | SUBTRACT_GREEN << 1, 6)  # one transform; no colour cache, one group of codes
        head.code(lengths)
        for s in (0, 0, 255):  # red, blue and alpha: simple codes of one symbol
            head.put(0b101 | s << 3, 11)
        head.code(far_lengths)
        heads.append(head)
        codes.append(code)
        far_codes.append(far_code)
    # the bits of each token: a code, or for a reference two of them with what follows each
    entry = np.concatenate(codes)[index]
    value, n = entry >> np.uint64(4), entry & np.uint64(15)
    far_entry = np.concatenate(far_codes)[far_index]
    v, m = value[ref], n[ref]
    for part, bits in ((size_extra, size_bits), (far_entry >> np.uint64(4), far_entry & np.uint64(15)), (far_extra, far_bits)):
        v |= part.astype(np.uint64) << m
        m += bits.astype(np.uint64)
    value[ref], n[ref] = v, m
    value, n, of = value[kept], n[kept].astype(np.int64), plane[kept]
    body = np.bincount(of, n, len(sizes)).astype(np.int64)
    head_bits = np.array([h.at for h in heads])
    body_bytes = 5 + (head_bits + body + 7) // 8
    file_bytes = 20 + body_bytes + (body_bytes & 1)
    file_start = np.cumsum(file_bytes) - file_bytes
    total = int(file_bytes.sum())
    at = np.cumsum(n) - n + (8 * (file_start + _HEAD) + head_bits - (np.cumsum(body) - body))[of]
    out = np.zeros(total // 8 + 3, np.uint64)
    where, shift = at >> 6, (at & 63).astype(np.uint64)
    for place, part in ((where, value << shift), (where + 1, np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0)))):
        cut = np.flatnonzero(np.diff(place, prepend=-1))
        out[place[cut]] |= np.bitwise_or.reduceat(part, cut)
    out = out.view(np.uint8)[:total]
    for lo, head in zip((file_start + _HEAD).tolist(), heads, strict=True):
        held = np.frombuffer(head.bytes(), np.uint8)
        out[lo : lo + len(held)] |= held
    fields = np.zeros((len(sizes), _HEAD), np.uint8)
    fields[:] = np.frombuffer(b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f\0\0\0\0", np.uint8)
    fields[:, 4:8] = (file_bytes - 8).astype("<u4").view(np.uint8).reshape(-1, 4)
    fields[:, 16:20] = body_bytes.astype("<u4").view(np.uint8).reshape(-1, 4)
    fields[:, 21:25] = (SIDE - 1 | (sizes // SIDE - 1) << 14).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[file_start[:, None] + np.arange(_HEAD)] = fields
    return out, file_bytes


def _ramp(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def file_spans(data: bytes) -> list[tuple[int, int]]:
    """Spans of the files that lie on end in ``data``."""
    out, at = [], 0
    while at < len(data):
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        out.append((at, end))
        at = end
    return out


def decode_planes(data: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Grey samples of the files at ``spans``, on end in the files' order, and the samples of each file."""
    heads, shapes, general = [], [], {}
    for k, (lo, hi) in enumerate(spans):
        parsed = File(bytes(data[lo:hi]))
        if [t[0] for t in parsed.transforms] != [SUBTRACT_GREEN] or parsed.coded.meta is not None:
            general[k] = bytes(data[lo:hi])
            continue
        heads.append(parsed.coded)
        shapes.append((k, lo + 20, hi))
    flat: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(spans)
    for k, file in general.items():
        flat[k] = ((decode([file])[0] >> 8) & 0xFF).astype(np.uint8).ravel()
    counts = np.zeros(len(spans), np.int64)
    if heads:
        matrix, order, sizes, _ = _lockstep(heads, data, np.array([s[1] for s in shapes]), np.array([s[2] for s in shapes]))
        green = np.ascontiguousarray((matrix >> 8).astype(np.uint8).T)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        sizes = sizes[back]
        if not general:
            return green[back][np.arange(green.shape[1]) < sizes[:, None]], sizes
        for k, (i, _, _) in enumerate(shapes):
            flat[i] = green[back[k], : sizes[k]]
    counts[:] = [len(x) for x in flat]
    return np.concatenate(flat) if flat else np.zeros(0, np.uint8), counts
