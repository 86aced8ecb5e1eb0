"""A plain writer of lossless WebP files that applies the forward transforms; for tests of the reader only."""

import struct

import numpy as np

from umbra.llm import webp


class Bits:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value, n):
        self.value |= int(value) << self.n
        self.n += n


def _image(bits, pixels, width, main, cache_bits=0, index=None, size=2, copies=()):
    """``copies``: {pixel: (length, distance code)}; cache symbols are used for every colour that is in the cache."""
    bits.put(1 if cache_bits else 0, 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    across = (width + (1 << size) - 1) >> size
    if main:
        bits.put(0 if index is None else 1, 1)
        if index is not None:
            bits.put(size - 2, 3)
            _image(bits, np.asarray(index, np.uint32) << 8, across, False)
    groups = 1 if index is None else max(index) + 1
    group_of = lambda k: 0 if index is None else index[(k // width >> size) * across + (k % width >> size)]
    tokens, cache, k = [], {}, 0
    copies = dict(copies)
    while k < len(pixels):
        begin = k
        if k in copies:
            n, code = copies[k]
            tokens.append((group_of(k), "copy", n, code))
            k += n
        else:
            p = int(pixels[k])
            place = (webp.CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
            tokens.append((group_of(k), "cache", place, 0) if cache_bits and cache.get(place) == p else (group_of(k), "pixel", p, 0))
            k += 1
        for p in pixels[begin:k]:
            if cache_bits:
                cache[(webp.CACHE_MULTIPLIER * int(p) & 0xFFFFFFFF) >> (32 - cache_bits)] = int(p)
    alphabets = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    coded = []
    for g in range(groups):
        counts = [{} for _ in range(5)]
        add = lambda c, s: counts[c].__setitem__(s, counts[c].get(s, 0) + 1)
        for group, kind, a, b in tokens:
            if group != g:
                continue
            if kind == "pixel":
                for c, shift in enumerate((8, 16, 0, 24)):
                    add(c, a >> shift & 255)
            elif kind == "cache":
                add(0, 280 + a)
            else:
                add(0, 256 + webp.prefix_of(a)[0])
                add(4, webp.prefix_of(b)[0])
        put, codes = [], []
        for c in range(5):
            some = counts[c] or {0: 1}
            if len(some) == 1 and next(iter(some)) >= 256:
                some = some | {0: 1}
            lengths = webp.code_lengths(some)
            webp._put_prefix(put, lengths, alphabets[c])
            codes.append(webp.canonical(lengths) if len(lengths) > 1 else dict.fromkeys(lengths, (0, 0)))
        for value, n in put:
            bits.put(value, n)
        coded.append(codes)
    for group, kind, a, b in tokens:
        codes = coded[group]
        if kind == "pixel":
            for c, shift in enumerate((8, 16, 0, 24)):
                bits.put(*codes[c][a >> shift & 255])
        elif kind == "cache":
            bits.put(*codes[0][280 + a])
        else:
            for c, value in ((0, a), (4, b)):
                symbol, extra, n = webp.prefix_of(value)
                bits.put(*codes[c][symbol + (256 if c == 0 else 0)])
                bits.put(extra, n)


def _split(pixels):
    return np.asarray(pixels, "<u4").view(np.uint8).reshape(-1, 4)


def write(pixels, width, transforms=(), **options):
    """``transforms``: in the order of the file: ("predictor", modes), ("cross", blocks), ("green",), ("palette",)."""
    pixels = np.asarray(pixels, np.uint32)
    height = len(pixels) // width
    bits = Bits()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        bits.put(value, n)
    now = width
    for kind, *more in transforms:
        bits.put(1, 1)
        if kind == "green":
            bits.put(2, 2)
            c = _split(pixels).copy()
            c[:, 2] -= c[:, 1]
            c[:, 0] -= c[:, 1]
            pixels = c.view("<u4").ravel()
        elif kind == "palette":
            bits.put(3, 2)
            colours = np.unique(pixels)
            bits.put(len(colours) - 1, 8)
            table = _split(colours).astype(int)
            _image(bits, np.diff(table, axis=0, prepend=0).astype(np.uint8).view("<u4").ravel(), len(colours), False)
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            index = np.searchsorted(colours, pixels).reshape(height, now)
            depth, new = 8 >> pack, (now + (1 << pack) - 1) >> pack
            packed = np.zeros((height, new), np.uint32)
            for x in range(now):
                packed[:, x >> pack] |= (index[:, x] << ((x & ((1 << pack) - 1)) * depth)).astype(np.uint32)
            pixels, now = 0xFF000000 | packed.ravel() << 8, new
        elif kind == "cross":
            bits.put(1, 2)
            bits.put(0, 3)
            blocks = np.asarray(more[0], np.uint32)
            across = (now + 3) >> 2
            _image(bits, blocks, across, False)
            c, k = _split(pixels).copy(), np.arange(len(pixels))
            b = _split(blocks)[(k // now >> 2) * across + (k % now >> 2)]
            c[:, 0] = (c[:, 0].astype(int) - webp._delta(b[:, 1], c[:, 1]) - webp._delta(b[:, 2], c[:, 2])) & 255
            c[:, 2] = (c[:, 2].astype(int) - webp._delta(b[:, 0], c[:, 1])) & 255
            pixels = c.view("<u4").ravel()
        else:
            bits.put(0, 2)
            bits.put(0, 3)
            modes = np.asarray(more[0], np.uint32)
            across = (now + 3) >> 2
            _image(bits, modes << 8, across, False)
            c = _split(pixels).astype(int)
            out = c.copy()
            for k in range(len(c)):
                x, y = k % now, k // now
                if y == 0:
                    guess = c[k - 1] if x else np.array([0, 0, 0, 255])
                elif x == 0:
                    guess = c[k - now]
                else:
                    guess = webp.predicted(int(modes[(y >> 2) * across + (x >> 2)]), c[k - 1], c[k - now], c[k - now + 1], c[k - now - 1])
                out[k] = (c[k] - guess) & 255
            pixels = out.astype(np.uint8).view("<u4").ravel()
    bits.put(0, 1)
    _image(bits, pixels, now, True, **options)
    body = bits.value.to_bytes((bits.n + 7) // 8, "little")
    odd = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(odd)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + odd
