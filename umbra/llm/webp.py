"""Reading and writing of lossless WebP images (the VP8L bit stream in its RIFF container).

The reader takes every feature of the format: simple and normal prefix codes, several groups of them chosen by an
entropy image, back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette
transforms. Images with one group of codes and no colour cache are read a run at a time: the code at *every* bit
position is looked up at once, so that only the chain of positions has to be followed.

The writer stores 8-bit samples as a grey image: green carries the sample, subtract-green restores red and blue.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CACHE_MULTIPLIER = 0x1E35A7BD
MAX_SIDE = 16384
MAX_COPY = 4096
#: (dx, dy) of the short distance codes from 1 on: nearest pixels first, the upper and the left one before others as near.
NEAR = sorted(
    ((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]),
)


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the bit stream ends too early")
        return value


class Prefix:
    """A prefix code as tables over the next ``bits`` bits: the symbol, and how many bits it takes."""

    def __init__(self, used: tuple[tuple[int, int], ...]):
        """``used``: (length, symbol), ascending. ``entry`` has the symbol above four bits for the length."""
        if len(used) < 2:
            self.bits, self.only = 0, used[0][1] if used else 0
            self.entry = np.array([self.only << 4], np.intp)
            self.steps = [self.only << 4]
            return
        self.bits, self.only = used[-1][0], None
        self.entry = np.zeros(1 << self.bits, np.intp)
        if sum(1 << (self.bits - n) for n, _ in used) != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        code, last = 0, used[0][0]
        for n, symbol in used:
            code <<= n - last
            last = n
            turned = int(f"{code:0{n}b}"[::-1], 2)
            self.entry[turned :: 1 << n] = symbol << 4 | n
            code += 1
        self.steps = memoryview(self.entry)

    def read(self, bits: BitReader) -> int:
        if not self.bits:
            return self.only
        byte = bits.at >> 3
        entry = self.steps[int.from_bytes(bits.data[byte : byte + 4], "little") >> (bits.at & 7) & ((1 << self.bits) - 1)]
        bits.at += entry & 15
        return entry >> 4


@lru_cache(512)
def _prefix(used: tuple[tuple[int, int], ...]) -> Prefix:
    return Prefix(used)


def prefix(lengths: dict[int, int]) -> Prefix:
    """The canonical code with these lengths by symbol; a code of one symbol takes no bits."""
    return _prefix(tuple(sorted((n, symbol) for symbol, n in lengths.items() if n)))


def read_prefix(bits: BitReader, alphabet: int) -> Prefix:
    if bits.take(1):
        two = bits.take(1)
        symbols = [bits.take(8 if bits.take(1) else 1)]
        if two:
            symbols.append(bits.take(8))
        return prefix(dict.fromkeys(symbols, 1))
    lengths = {}
    for k in range(4 + bits.take(4)):
        lengths[CODE_LENGTH_ORDER[k]] = bits.take(3)
    coder = prefix(lengths)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    out, symbol, last = {}, 0, 8
    while symbol < alphabet and left:
        left -= 1
        code = coder.read(bits)
        if code < 16:
            if code:
                out[symbol] = last = code
            symbol += 1
            continue
        n = 3 + bits.take(2) if code == 16 else 3 + bits.take(3) if code == 17 else 11 + bits.take(7)
        if symbol + n > alphabet:
            raise ValueError("code lengths run over the alphabet")
        if code == 16:
            out.update(dict.fromkeys(range(symbol, symbol + n), last))
        symbol += n
    return prefix(out)


def value_of(prefix: int, bits: BitReader) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def _copy(pixels: np.ndarray, at: int, distance: int, n: int) -> None:
    if distance > at or at + n > len(pixels):
        raise ValueError("a back-reference leaves the image")
    while n:
        some = min(n, distance)
        pixels[at : at + some] = pixels[at - distance : at - distance + some]
        at += some
        n -= some


def _read_runs(bits: BitReader, codes: list[Prefix], width: int, total: int) -> np.ndarray:
    """Pixels of an image with one group of codes and no colour cache."""
    green, red, blue, alpha, distances = codes
    pixels = np.empty(total, np.uint32)
    constant = [c.only for c in codes]
    if None not in constant[:4] and constant[0] < 256:
        pixels[:] = constant[3] << 24 | constant[1] << 16 | constant[0] << 8 | constant[2]
        return pixels
    first = bits.at >> 3
    raw = np.frombuffer(bits.data[first:] + b"\0\0\0", np.uint8).astype(np.intp)
    wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    end = 8 * (len(wide) - 1)  # the windows of the zeros that were added serve as the end
    windows = (wide[:, None] >> np.arange(8)).ravel()[: end + 1]
    here = np.arange(end + 1)
    symbol = green.entry.take(windows & ((1 << green.bits) - 1))
    after = here + (symbol & 15)
    np.minimum(after, end, out=after)
    channels = []
    for code in (red, blue, alpha):
        if code.bits:
            entry = code.entry.take(windows & ((1 << code.bits) - 1))
            channels.append((entry, after))
            after = np.minimum(after + (entry & 15).take(after), end)
        else:
            channels.append((None, None))
    special = symbol >= 256 << 4
    special[end] = True
    one = np.where(special, here, after)
    two = one.take(one)
    four = two.take(two)
    eight = four.take(four)
    step = memoryview(eight)
    done, p = 0, bits.at - 8 * first
    while done < total:
        starts, most = [p], (total - done + 7) // 8
        q = step[p]
        while q != p and len(starts) < most:
            starts.append(q)
            p, q = q, step[q]
        chain = np.empty((len(starts), 8), np.intp)
        chain[:, 0] = starts
        chain[:, 1] = one.take(chain[:, 0])
        chain[:, 2:4] = two.take(chain[:, :2])
        chain[:, 4:] = four.take(chain[:, :4])
        chain = chain.ravel()[: total - done]
        stops = special.take(chain)
        n = int(stops.argmax()) if stops.any() else len(chain)
        run = chain[:n]
        value = symbol.take(run) >> 4 << 8
        for shift, k, (s, at) in ((16, 1, channels[0]), (0, 2, channels[1]), (24, 3, channels[2])):
            value |= constant[k] << shift if s is None else s.take(at.take(run)) >> 4 << shift
        pixels[done : done + n] = value
        done += n
        p = int(one[run[-1]]) if n else starts[0]
        if done < total:
            if n < len(chain):
                p = int(chain[n])
            if not special[p]:
                continue
            if p >= end:
                raise ValueError("the bit stream ends too early")
            bits.at = 8 * first + p
            length = value_of(green.read(bits) - 256, bits)
            distance = distance_of(value_of(distances.read(bits), bits), width)
            _copy(pixels, done, distance, length)
            done += length
            p = bits.at - 8 * first
    bits.at = 8 * first + p
    return pixels


def _read_pixels(bits: BitReader, groups: list[list[Prefix]], group_of, cache_bits: int, width: int, total: int) -> np.ndarray:
    """Pixels of any image, symbol by symbol; ``group_of(k)``: the group of codes for pixel k."""
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else None
    k = 0
    while k < total:
        codes = groups[group_of(k)]
        s = codes[0].read(bits)
        begin = k
        if s < 256:
            r = codes[1].read(bits)
            b = codes[2].read(bits)
            out[k] = codes[3].read(bits) << 24 | r << 16 | s << 8 | b
            k += 1
        elif s < 280:
            n = value_of(s - 256, bits)
            _copy(out, k, distance_of(value_of(codes[4].read(bits), bits), width), n)
            k += n
        else:
            if cache is None or s - 280 >= len(cache):
                raise ValueError("a colour outside the cache")
            out[k] = cache[s - 280]
            k += 1
        if cache is not None:
            for value in out[begin:k].tolist():
                cache[(CACHE_MULTIPLIER * value & 0xFFFFFFFF) >> (32 - cache_bits)] = value
    return out


def _entropy_image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    index = None
    if main and bits.take(1):
        size = bits.take(3) + 2
        across = (width + (1 << size) - 1) >> size
        down = (height + (1 << size) - 1) >> size
        index = _entropy_image(bits, across, down, False) >> 8 & 0xFFFF
    groups = []
    for _ in range(1 if index is None else int(index.max()) + 1):
        groups.append([read_prefix(bits, n) for n in (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)])
    if index is None:
        if not cache_bits:
            return _read_runs(bits, groups[0], width, width * height)
        return _read_pixels(bits, groups, lambda k: 0, cache_bits, width, width * height)
    group_of = lambda k: index[(k // width >> size) * across + (k % width >> size)]
    return _read_pixels(bits, groups, group_of, cache_bits, width, width * height)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4): blue, green, red, alpha."""
    return pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4)


def predicted(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction from the left, upper, upper right and upper left pixels, each of four channels as integers."""
    half = lambda a, b: (a + b) >> 1
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return half(half(left, right), top)
        case 6:
            return half(left, corner)
        case 7:
            return half(left, top)
        case 8:
            return half(corner, top)
        case 9:
            return half(top, right)
        case 10:
            return half(half(left, corner), half(top, right))
        case 11:
            to_left = np.abs(top - corner).sum()
            to_top = np.abs(left - corner).sum()
            return left if to_left < to_top else top
        case 12:
            return np.clip(left + top - corner, 0, 255)
        case 13:
            mean = half(left, top)
            d = mean - corner
            return np.clip(mean + np.where(d < 0, -(-d // 2), d // 2), 0, 255)
        case _:
            return np.array([0, 0, 0, 255])


def _undo_predictor(pixels: np.ndarray, width: int, height: int, size: int, modes: np.ndarray) -> np.ndarray:
    out = _channels(pixels).astype(np.int32)
    across = (width + (1 << size) - 1) >> size
    for k in range(width * height):
        x, y = k % width, k // width
        if y == 0:
            guess = out[k - 1] if x else np.array([0, 0, 0, 255])
        elif x == 0:
            guess = out[k - width]
        else:
            mode = int(modes[(y >> size) * across + (x >> size)] >> 8 & 15)
            guess = predicted(mode, out[k - 1], out[k - width], out[k - width + 1], out[k - width - 1])
        out[k] = (out[k] + guess) & 255
    return out.astype(np.uint8).view("<u4").ravel()


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32) >> 5


def _undo_cross_colour(pixels: np.ndarray, width: int, height: int, size: int, blocks: np.ndarray) -> np.ndarray:
    out = _channels(pixels).copy()
    across = (width + (1 << size) - 1) >> size
    k = np.arange(width * height)
    block = _channels(blocks)[(k // width >> size) * across + (k % width >> size)]
    red = (out[:, 2] + _delta(block[:, 0], out[:, 1])).astype(np.uint8)
    blue = (out[:, 0] + _delta(block[:, 1], out[:, 1]) + _delta(block[:, 2], red)).astype(np.uint8)
    out[:, 2], out[:, 0] = red, blue
    return out.view("<u4").ravel()


def _undo_palette(pixels: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    green = (pixels >> 8 & 255).reshape(height, -1)
    x = np.arange(width)
    depth = 8 >> pack
    index = green[:, x >> pack] >> ((x & ((1 << pack) - 1)) * depth).astype(np.uint32) & ((1 << depth) - 1)
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index].ravel()


def read(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels as 32-bit ARGB values in rows) of one lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    (size,) = struct.unpack("<I", data[16:20])
    body = data[20 : 20 + size]
    if not body or body[0] != 0x2F:
        raise ValueError("not a lossless bit stream")
    bits = BitReader(body)
    bits.at = 8
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("an unknown version")
    undo, now = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in [u[0] for u in undo]:
            raise ValueError("a transform comes twice")
        if kind == SUBTRACT_GREEN:
            undo.append((kind, now, 0, None))
        elif kind == PALETTE:
            n = bits.take(8) + 1
            table = _channels(_entropy_image(bits, n, 1, False))
            colours = np.cumsum(table, axis=0, dtype=np.uint8).astype(np.uint8).view("<u4").ravel()
            undo.append((kind, now, 0, colours))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            now = (now + (1 << pack) - 1) >> pack
        else:
            size = bits.take(3) + 2
            blocks = _entropy_image(bits, (now + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size, False)
            undo.append((kind, now, size, blocks))
    pixels = _entropy_image(bits, now, height, True)
    for kind, across, size, more in reversed(undo):
        if kind == SUBTRACT_GREEN:
            green = pixels >> 8 & 255
            red, blue = (pixels >> 16) + green & 255, pixels + green & 255
            pixels = (pixels & 0xFF00FF00) | red << 16 | blue
        elif kind == PALETTE:
            pixels = _undo_palette(pixels, across, height, more)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, across, height, size, more)
        else:
            pixels = _undo_predictor(pixels, across, height, size, more)
    return width, height, pixels.astype(np.uint32)


def code_lengths(counts: dict[int, int], longest: int = 15) -> dict[int, int]:
    """Lengths of a prefix code for the counted symbols, none above ``longest``."""
    floor = 0
    while True:
        heap = [(max(n, floor), k, (k,)) for k, n in sorted(counts.items())]
        heapq.heapify(heap)
        lengths = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for k in a[2] + b[2]:
                lengths[k] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(lengths.values()) <= longest:
            return lengths
        floor = 2 * floor + 1


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """The bits of each symbol, first bit lowest, and their number."""
    out, code, last = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - last
        last = n
        out[symbol] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


# A complete code for code lengths: runs of zeros in three bits, usual lengths in four, the others in five.
_LENGTH_CODE = {17: 3, 18: 3} | dict.fromkeys(range(3, 11), 4) | dict.fromkeys([0, 1, 2, 11, 12, 13, 14, 15], 5)
_LENGTH_BITS = canonical(_LENGTH_CODE)


def _put_prefix(put: list[tuple[int, int]], lengths: dict[int, int], alphabet: int) -> None:
    if len(lengths) == 1 and (symbol := next(iter(lengths))) < 256:
        put += [(1, 1), (0, 1), (1, 1), (symbol, 8)]
        return
    put += [(0, 1), (15, 4)] + [(_LENGTH_CODE.get(k, 0), 3) for k in CODE_LENGTH_ORDER] + [(0, 1)]
    at = 0
    for symbol in [*sorted(lengths), alphabet]:
        while (gap := symbol - at) > 0:
            if gap >= 11:
                n = min(gap, 138)
                put += [_LENGTH_BITS[18], (n - 11, 7)]
            elif gap >= 3:
                n = gap
                put += [_LENGTH_BITS[17], (n - 3, 3)]
            else:
                n = 1
                put.append(_LENGTH_BITS[0])
            at += n
        if symbol < alphabet:
            put.append(_LENGTH_BITS[lengths[symbol]])
            at = symbol + 1


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    high = value.bit_length() - 1
    second = value >> (high - 1) & 1
    return 2 * high + second, value & ((1 << (high - 1)) - 1), high - 1


def repeats(samples: np.ndarray, least: int = 24) -> list[tuple[int, int, int]]:
    """(begin, length, distance) of passages that stand earlier in the samples, from left to right without overlap."""
    n = len(samples) - 7
    if n < least:
        return []
    grams = np.ndarray((n,), "<u8", samples.tobytes(), strides=(1,)).copy()
    here = np.arange(n, dtype=np.int32)
    place = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int32)
    first = np.full(1 << 14, n, np.int32)
    first[place[::-1]] = here[::-1]
    source = first[place]
    source[1:][grams[1:] == grams[:-1]] = here[:-1][grams[1:] == grams[:-1]]
    source[source >= here] = -1
    source[(source >= 0) & (grams[source] != grams)] = -1
    distance = np.where(source < 0, 0, here - source)
    edges = np.flatnonzero(np.diff(distance)) + 1
    begins = np.concatenate([[0], edges])
    lengths = np.diff(np.concatenate([begins, [n]])) + 7
    out, free = [], 0
    for k in np.flatnonzero((lengths >= least) & (distance[begins] > 0) & (distance[begins] < 1_000_000)).tolist():
        begin, end = max(int(begins[k]), free), int(begins[k] + lengths[k])
        while end - begin >= least:
            some = min(end - begin, MAX_COPY)
            out.append((begin, some, int(distance[begins[k]])))
            begin += some
        free = max(free, begin)
    return out


def write_grey(samples: np.ndarray, width: int) -> bytes:
    """One lossless WebP file whose pixels are the 8-bit ``samples`` in rows of ``width``."""
    height = len(samples) // width
    copies = repeats(samples)
    literal = np.ones(len(samples), bool)
    for begin, n, _ in copies:
        literal[begin : begin + n] = False
    count = np.bincount(samples[literal], minlength=256)
    counts = {int(k): int(count[k]) for k in np.flatnonzero(count)}
    distances: dict[int, int] = {}
    parts = []
    for _, n, distance in copies:
        a, b = prefix_of(n), prefix_of(distance + len(NEAR))
        parts.append((a, b))
        counts[256 + a[0]] = counts.get(256 + a[0], 0) + 1
        distances[b[0]] = distances.get(b[0], 0) + 1
    if len(counts) == 1 and copies:
        counts[0 if 0 not in counts else 1] = 1
    lengths = code_lengths(counts)
    far = code_lengths(distances or {0: 1})
    put = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3), (1, 1), (SUBTRACT_GREEN, 2), (0, 1), (0, 1), (0, 1)]
    _put_prefix(put, lengths, 280)
    for symbol in (0, 0, 255):
        _put_prefix(put, {symbol: 0}, 256)
    _put_prefix(put, far, 40)
    code = np.zeros(280, np.uint64)
    bits = np.zeros(280, np.int64)
    if len(lengths) > 1:
        for symbol, (value, n) in canonical(lengths).items():
            code[symbol], bits[symbol] = value, n
    far_bits = canonical(far) if len(far) > 1 else dict.fromkeys(far, (0, 0))
    # A copy takes the places of its first two samples in the list of values to write.
    wanted = literal.copy()
    values, sizes = code[samples], bits[samples]
    for (begin, _, _), (a, b) in zip(copies, parts, strict=True):
        n = int(bits[256 + a[0]])
        values[begin], sizes[begin] = int(code[256 + a[0]]) | a[1] << n, n + a[2]
        value, n = far_bits[b[0]]
        values[begin + 1], sizes[begin + 1] = value | b[1] << n, n + b[2]
        wanted[begin : begin + 2] = True
    head = np.array(put, np.uint64)
    values = np.concatenate([head[:, 0], values[wanted]])
    sizes = np.concatenate([head[:, 1].astype(np.int64), sizes[wanted]])
    ends = np.cumsum(sizes)
    at = ends - sizes
    word = at >> 5
    moved = values << (at & 31).astype(np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[starts]] += np.add.reduceat(moved & np.uint64(0xFFFFFFFF), starts)
    out[word[starts] + 1] += np.add.reduceat(moved >> np.uint64(32), starts)
    body = out.astype("<u4").tobytes()[: (int(ends[-1]) + 7) // 8]
    odd = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(odd)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + odd
