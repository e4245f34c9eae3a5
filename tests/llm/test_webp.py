"""The lossless WebP decoder on files that use every part of the format, written by a small encoder of its own."""

import numpy as np
import pytest

from portcullis.llm import webp as w


class Image:
    """Writes an image as literals, colour-cache hits and back-references with its own prefix codes."""

    def __init__(self, out, argb, cache=0, refs=False, groups=None, main=True):
        height, width = argb.shape
        flat = argb.ravel().tolist()
        ops, seen, i = [], {}, 0
        while i < len(flat):
            run = 0
            if refs and i:
                for d in (1, width, 2):
                    if d <= i:
                        n = 0
                        while i + n < len(flat) and n < 4000 and flat[i + n] == flat[i + n - d]:
                            n += 1
                        if n > max(run, 2):
                            run, dist = n, d
            key = (flat[i] * w.CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache) if cache else None
            if run:
                ops.append(("ref", run, dist, i))
            elif cache and seen.get(key) == flat[i]:
                ops.append(("cache", key, 0, i))
            else:
                ops.append(("lit", flat[i], 0, i))
            for v in flat[i : i + max(run, 1)]:
                if cache:
                    seen[(v * w.CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache)] = v
            i += max(run, 1)
        out.put(int(bool(cache)), 1)
        if cache:
            out.put(cache, 4)
        if main:
            out.put(int(groups is not None), 1)
            if groups is not None:
                bits, table = groups
                out.put(bits - 2, 3)
                Image(out, (table.astype(np.uint32) << 8), main=False)
        n = 1 if groups is None else int(groups[1].max()) + 1
        of = (lambda i: 0) if groups is None else lambda i: int(groups[1][i // width >> groups[0], i % width >> groups[0]])
        counts = [[[0] * (280 + (1 << cache if cache else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40] for _ in range(n)]

        def symbols(op):
            kind, value, dist, _ = op
            if kind == "lit":
                return [(0, value >> 8 & 255, 0, 0), (1, value >> 16 & 255, 0, 0), (2, value & 255, 0, 0), (3, value >> 24, 0, 0)]
            if kind == "cache":
                return [(0, 280 + value, 0, 0)]
            code = {1: 2, width: 1}.get(dist, dist + 120)
            out_ = []
            for k, v in ((0, value), (4, code)):
                s, e, c = (int(x[0]) for x in w._length_symbol(np.array([v])))
                out_.append((k, s + (256 if k == 0 else 0), e, c))
            return out_

        for op in ops:
            for k, s, _, _ in symbols(op):
                counts[of(op[3])][k][s] += 1
        codes = []
        for group in counts:
            own = []
            for c in group:
                lengths = w.huffman(c) if any(c) else [1] + [0] * (len(c) - 1)
                if sum(map(bool, lengths)) == 1 and lengths.index(max(lengths)) >= 256:
                    lengths[0] = 1
                out.code(lengths)
                own.append((lengths, w.canonical(lengths), sum(map(bool, lengths)) == 1))
            codes.append(own)
        for op in ops:
            for k, s, e, c in symbols(op):
                lengths, code, lone = codes[of(op[3])][k]
                if not lone:
                    out.put(code[s], lengths[s])
                out.put(e, c)


def make(argb, transforms=(), coded=None, **how):
    out = w.Writer()
    height, width = argb.shape
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind, *more in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (w.PREDICTOR, w.CROSS_COLOUR):
            out.put(more[0] - 2, 3)
            Image(out, more[1], main=False)
        elif kind == w.PALETTE:
            out.put(len(more[0]) - 1, 8)
            lanes = w.channels(more[0])
            Image(out, w.joined(np.diff(lanes, axis=0, prepend=0))[None], main=False)
    out.put(0, 1)
    Image(out, argb if coded is None else coded, **how)
    body = out.bytes()
    head = b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + len(head).to_bytes(4, "little") + head


@pytest.fixture
def picture():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 32, (23, 31), dtype=np.uint64).astype(np.uint32)
    base[5:15, 4:20] = base[5, 4]
    base[16:, :] = base[2, :]
    return base


@pytest.mark.parametrize("cache", [0, 1, 6, 11])
@pytest.mark.parametrize("refs", [False, True])
def test_literals_cache_and_references(picture, cache, refs):
    assert (w.decode([make(picture, cache=cache, refs=refs)])[0] == picture).all()


def test_prefix_code_groups(picture):
    table = np.arange(6 * 8).reshape(6, 8) % 5
    assert (w.decode([make(picture, cache=4, refs=True, groups=(2, table))])[0] == picture).all()


def test_many_files_at_once(picture):
    files = [make(picture[: 1 + i, : 31 - i], cache=i % 3 * 2, refs=i % 2 == 0) for i in range(12)]
    assert all((a == picture[: 1 + i, : 31 - i]).all() for i, a in enumerate(w.decode(files)))


def test_subtract_green(picture):
    lanes = w.channels(picture)
    lanes[..., 0] -= lanes[..., 1]
    lanes[..., 2] -= lanes[..., 1]
    assert (w.decode([make(picture, [(w.SUBTRACT_GREEN,)], w.joined(lanes), refs=True)])[0] == picture).all()


def test_predictor_inverts_all_modes(picture):
    h, width = picture.shape
    blocks = (np.arange(6 * 8).reshape(6, 8) % 14).astype(np.uint32) << 8
    lanes, left = w.channels(picture), np.zeros((h, width, 4), np.int64)
    for y in range(h):
        for x in range(width):
            at = lambda dy, dx: lanes[y + dy, x + dx] if x + dx < width else lanes[y, 0]  # noqa: B023, E731
            if y == 0 or x == 0:
                p = np.array([0, 0, 0, 255]) if x == y == 0 else at(0, -1) if y == 0 else at(-1, 0)
            else:
                p = w._predict(int(blocks[y >> 2, x >> 2] >> 8), at(0, -1), at(-1, 0), at(-1, 1), at(-1, -1))
            left[y, x] = lanes[y, x] - p
    assert (w.decode([make(picture, [(w.PREDICTOR, 2, blocks)], w.joined(left))])[0] == picture).all()


def test_cross_colour(picture):
    r = np.random.default_rng(8)
    blocks = r.integers(0, 1 << 24, (6, 8), dtype=np.uint32) | np.uint32(0xFF000000)
    sign = lambda v: (v & 0xFF ^ 0x80) - 0x80
    f = sign(w.channels(np.repeat(np.repeat(blocks, 4, 0), 4, 1)[:23, :31]))
    lanes = w.channels(picture)
    green, red = sign(lanes[..., 1]), sign(lanes[..., 2])
    coded = lanes.copy()
    coded[..., 2] -= f[..., 0] * green >> 5
    coded[..., 0] -= (f[..., 1] * green >> 5) + (f[..., 2] * red >> 5)
    assert (w.decode([make(picture, [(w.CROSS_COLOUR, 2, blocks)], w.joined(coded))])[0] == picture).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 16, 17, 200])
def test_palette(colours):
    r = np.random.default_rng(colours)
    table = r.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    index = r.integers(0, colours, (9, 21))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each, per = 8 >> bits, 1 << bits
    wide = np.pad(index, ((0, 0), (0, -21 % per))).reshape(9, -1, per)
    packed = (wide << (np.arange(per) * each)).sum(2).astype(np.uint32) << 8 | np.uint32(0xFF000000)
    assert (w.decode([make(table[index], [(w.PALETTE, table)], packed, cache=3)])[0] == table[index]).all()


def test_transforms_together(picture):
    lanes = w.channels(picture)
    lanes[..., 0] -= lanes[..., 1]
    lanes[..., 2] -= lanes[..., 1]
    green = w.joined(lanes)
    blocks = np.full((3, 4), 2 << 8, np.uint32)
    own = w.channels(green)
    left = own.copy()
    left[1:] -= own[:-1]
    left[0, 1:] -= own[0, :-1]
    left[0, 0] -= (0, 0, 0, 255)
    assert (w.decode([make(picture, [(w.SUBTRACT_GREEN,), (w.PREDICTOR, 3, blocks)], w.joined(left))])[0] == picture).all()


def test_broken_files(picture):
    good = make(picture, refs=True)
    with pytest.raises(ValueError, match="not a lossless"):
        w.decode([b"RIFFxxxxWEBPVP8 " + good[16:]])
    cut = bytearray(good[: len(good) // 2])
    cut[16:20] = (len(cut) - 20).to_bytes(4, "little")
    with pytest.raises((ValueError, IndexError)):
        w.decode([bytes(cut)])


def test_planes():
    r = np.random.default_rng(4)
    sizes = np.array([2304, 576, 1152, 2304])
    data = r.integers(0, 256, int(sizes.sum()), dtype=np.uint8)
    tails = np.array([0, 576, 1, 300])
    for end, n in zip(np.cumsum(sizes), tails, strict=True):
        data[end - n : end] = 255
    files, lengths = w.encode_planes(data, sizes, tails)
    got, counts = w.decode_planes(files, w.file_spans(files.tobytes()))
    assert (got == data).all() and (counts == sizes).all() and lengths.sum() == len(files)
    whole = w.decode([files[a:b].tobytes() for a, b in w.file_spans(files.tobytes())])
    assert (np.concatenate([x.ravel() >> 8 & 255 for x in whole]) == data).all() and {x >> 24 for i in whole for x in i.ravel().tolist()} == {255}


def test_planes_have_codes_and_references_of_their_own():
    r = np.random.default_rng(5)
    phrase = r.integers(97, 123, 48, dtype=np.uint8)
    data = np.concatenate([r.integers(97, 101, 576, dtype=np.uint8), r.integers(160, 168, 528, dtype=np.uint8), phrase, np.tile(phrase, 12)])
    sizes = np.array([576, 576, 576])
    files, lengths = w.encode_planes(data, sizes, np.array([0, 0, 0]))
    parsed = [w.File(files[a:b].tobytes()) for a, b in w.file_spans(files.tobytes())]
    green = [{int(e) >> 4 for e in f.coded.codes[0][0][0]} for f in parsed]
    assert {x for x in green[0] if x < 256} == set(data[:576].tolist())
    assert {x for x in green[1] if x < 256} == set(data[576:1152].tolist())
    assert any(x >= 256 for x in green[2]) and lengths[2] < 200  # the phrase once, then references
    got, _ = w.decode_planes(files, w.file_spans(files.tobytes()))
    assert (got == data).all()
