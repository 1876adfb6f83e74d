"""Lossless WebP: reading any VP8L picture, and storing bytes as pictures.

:func:`decode` reads every feature of the format: prefix codes and their meta codes,
back-references, the colour cache, and the predictor, cross-colour, subtract-green and
palette transforms. :func:`decode_many` reads a batch; pictures that hold literals under
one prefix-code group go through numpy side by side, a pixel of each at a time, and the
others through :func:`decode`. :func:`encode_rgb` stores RGB pictures with a prefix code
fitted to each; a picture that repeats itself is stored with a palette or a predictor,
back-references and a colour cache, where that is smaller.
"""

from __future__ import annotations

import functools
import heapq
import struct
import zlib

import numpy as np

#: Fixed values of the format: order of code-length codes, and the near distances (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# fmt: off
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
# fmt: on
BLACK = 0xFF000000
#: Longest code of pictures that go side by side; the format allows 15.
SIDE_BITS = 10
#: Pixels that a file may declare; a few bytes could name 2**28.
MOST_PIXELS = 1 << 24
#: A picture is worth a search for repeats where a quick compressor makes it so many times smaller, from so many pixels on.
REPEATS, LEAST_PIXELS = 6, 256
#: Bits of the writer's colour cache; longest back-reference of the format.
CACHE_BITS, LONGEST = 6, 4096


class WebpError(ValueError):
    """The bytes aren't a lossless WebP picture."""


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos, self.end = data, pos, 8 * len(data)

    def peek(self, n: int) -> int:
        """The next ``n`` bits, zeros beyond the end."""
        at = self.pos >> 3
        return (int.from_bytes(self.data[at : at + 8], "little") >> (self.pos & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        """Take the next ``n`` bits."""
        v = self.peek(n)
        self.pos += n
        if self.pos > self.end:
            raise WebpError("the data end early")
        return v


def canonical_table(lengths: np.ndarray) -> tuple[int, list[int], list[int]]:
    """Lookup of a prefix code: its longest length, and symbol and length by peeked bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 0:
        raise WebpError("an empty prefix code")
    if len(used) == 1:
        return 0, [int(used[0])], [0]
    longest = int(lengths.max())
    order = used[np.argsort(lengths[used], kind="stable")]
    own = lengths[order].astype(np.int64)
    spans = 1 << (longest - own)
    if spans.sum() != 1 << longest:
        raise WebpError("an incomplete prefix code")
    back = _reversed(longest)
    symbols, sizes = np.empty(1 << longest, np.int64), np.empty(1 << longest, np.int64)
    symbols[back], sizes[back] = np.repeat(order, spans), np.repeat(own, spans)
    return longest, symbols.tolist(), sizes.tolist()


@functools.lru_cache(maxsize=64)
def _length_table(lengths: bytes) -> tuple[int, list[int], list[int]]:
    return canonical_table(np.frombuffer(lengths, np.int64))


@functools.lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    """The numbers below 2**bits with their bits in reverse order."""
    x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for _ in range(bits):
        out, x = (out << 1) | (x & 1), x >> 1
    return out


def _lookup(bits: Bits, table: tuple[int, list[int], list[int]]) -> int:
    longest, symbols, sizes = table
    v = bits.peek(longest)
    bits.read(sizes[v])
    return symbols[v]


def read_lengths(bits: Bits, alphabet: int) -> np.ndarray:
    """Code lengths of one prefix code; a lone symbol has length 1 and takes no bits."""
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        count = bits.read(1) + 1
        first = bits.read(8 if bits.read(1) else 1)
        for symbol in [first] + [bits.read(8) for _ in range(count - 1)]:
            if symbol >= alphabet:
                raise WebpError("a symbol outside its alphabet")
            lengths[symbol] = 1
        return lengths
    own = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    longest, symbols, sizes = _length_table(own.tobytes())
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > alphabet:
            raise WebpError("too many code lengths")
    # a length takes 14 bits at most; bits come in windows of 512 bytes
    out: list[int] = []
    last, mask, room, v = 8, (1 << longest) - 1, 0, 0
    while len(out) < alphabet and left:
        left -= 1
        if room < 14:
            at = bits.pos >> 3
            v, room = int.from_bytes(bits.data[at : at + 512], "little") >> (bits.pos & 7), 4096 - (bits.pos & 7)
        k = v & mask
        c, size = symbols[k], sizes[k]
        if c < 16:
            out.append(c)
            last = c or last
        else:
            extra, least = (2, 3) if c == 16 else (3, 3) if c == 17 else (7, 11)
            out += [last if c == 16 else 0] * (least + (v >> size & ((1 << extra) - 1)))
            size += extra
        v >>= size
        room -= size
        bits.pos += size
    if len(out) > alphabet or bits.pos > bits.end:
        raise WebpError("code lengths beyond the alphabet or the data")
    lengths[: len(out)] = out
    return lengths


def _amount(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_header(bits: Bits) -> tuple[int, int]:
    """Width and height after the signature."""
    if bits.read(8) != 0x2F:
        raise WebpError("no lossless signature")
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("an unknown version")
    return w, h


def chunk_of(data: bytes) -> bytes:
    """The VP8L chunk of a RIFF file; other chunks are passed over."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebpError("no WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise WebpError("no lossless picture in the file")


def _read_pixels(bits: Bits, w: int, h: int, spatial: bool) -> list[int]:
    """One entropy-coded picture as ARGB numbers in reading order."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("a colour cache too large")
    meta, block_bits, across, groups = [0], 0, 1, 1
    if spatial and bits.read(1):
        block_bits = bits.read(3) + 2
        across = -(-w >> block_bits)
        meta = [(x >> 8) & 0xFFFF for x in _read_pixels(bits, across, -(-h >> block_bits), False)]
        groups = max(meta) + 1
    cache = [0] * (1 << cache_bits)
    codes = [[canonical_table(read_lengths(bits, n)) for n in (280 + (len(cache) if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    out: list[int] = []
    keep = 0  # pixels that are in the cache already
    one = groups == 1
    while len(out) < w * h:
        y, x = divmod(len(out), w)
        code = codes[0 if one else meta[(y >> block_bits) * across + (x >> block_bits)]]
        s = _lookup(bits, code[0])
        if s < 256:
            red, blue, alpha = _lookup(bits, code[1]), _lookup(bits, code[2]), _lookup(bits, code[3])
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _amount(bits, s - 256)
            far = _amount(bits, _lookup(bits, code[4]))
            if far > 120:
                far -= 120
            else:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * w)
            if far > len(out) or len(out) + length > w * h:
                raise WebpError("a reference outside the picture")
            while length > 0:  # a reference may reach into what it makes itself
                piece = out[len(out) - far : len(out) - far + length]
                out += piece
                length -= len(piece)
        else:
            while keep < len(out):
                cache[(0x1E35A7BD * out[keep] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[keep]
                keep += 1
            out.append(cache[s - 280])
    return out


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(v: int) -> tuple[int, int, int, int]:
    return v >> 24, (v >> 16) & 255, (v >> 8) & 255, v & 255


def _select(left: int, top: int, corner: int) -> int:
    a, b, c = _channels(left), _channels(top), _channels(corner)
    to_left = sum(abs(y - z) for y, z in zip(b, c, strict=True))
    to_top = sum(abs(x - z) for x, z in zip(a, c, strict=True))
    return left if to_left < to_top else top


def _clamped(*parts: int) -> int:
    out = 0
    for p in parts:
        out = out << 8 | min(max(p, 0), 255)
    return out


def _full(left: int, top: int, corner: int) -> int:
    return _clamped(*(a + b - c for a, b, c in zip(_channels(left), _channels(top), _channels(corner), strict=True)))


def _half(mean: int, corner: int) -> int:
    return _clamped(*(a + int((a - c) / 2) for a, c in zip(_channels(mean), _channels(corner), strict=True)))


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predicted ARGB number; ``right`` is the pixel above and to the right."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7):
        return _average(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return _average(top, corner if mode == 8 else right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _full(left, top, corner)
    if mode == 13:
        return _half(_average(left, top), corner)
    return BLACK


def _plus(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def undo_predictor(pixels: list[int], w: int, modes: list[int], block_bits: int) -> list[int]:
    """Add predictions to residuals in reading order; the pixel above, if it is the mode of all blocks, by sums down the columns."""
    if {v >> 8 & 15 for v in modes} == {2}:
        v = np.array(pixels, np.uint32).reshape(-1, w)
        parts = np.stack([v >> 24, v >> 16, v >> 8, v], axis=-1).astype(np.uint8)
        parts[0, 0, 0] += 255
        parts[0] = np.cumsum(parts[0], axis=0, dtype=np.uint8)
        x = np.cumsum(parts, axis=0, dtype=np.uint8).astype(np.uint32)
        return (x[..., 0] << 24 | x[..., 1] << 16 | x[..., 2] << 8 | x[..., 3]).ravel().tolist()
    out: list[int] = []
    across = -(-w >> block_bits)
    for i, residual in enumerate(pixels):
        y, x = divmod(i, w)
        if not i:
            guess = BLACK
        elif not y:
            guess = out[-1]
        elif not x:
            guess = out[i - w]
        else:
            guess = predict((modes[(y >> block_bits) * across + (x >> block_bits)] >> 8) & 15, out[i - 1], out[i - w], out[i - w + 1], out[i - w - 1])
        out.append(_plus(residual, guess))
    return out


def undo_cross_colour(pixels: list[int], w: int, factors: list[int], block_bits: int) -> list[int]:
    """Add the multiples of green to red and blue, and of red to blue."""
    signed = lambda v: v - 256 if v > 127 else v
    across, out = -(-w >> block_bits), []
    for i, v in enumerate(pixels):
        y, x = divmod(i, w)
        f = factors[(y >> block_bits) * across + (x >> block_bits)]
        alpha, red, green, blue = _channels(v)
        red = (red + (signed(f & 255) * signed(green) >> 5)) & 255
        blue = (blue + (signed((f >> 8) & 255) * signed(green) >> 5) + (signed((f >> 16) & 255) * signed(red) >> 5)) & 255
        out.append(alpha << 24 | red << 16 | green << 8 | blue)
    return out


def undo_palette(pixels: list[int], w: int, h: int, palette: list[int], pack: int) -> list[int]:
    """Look up indices, ``1 << pack`` of which share a pixel's green."""
    size, x = 8 >> pack, np.arange(w)
    green = np.array(pixels, np.int64).reshape(h, -1)[:, x >> pack] >> 8 & 255
    at = green >> ((x & ((1 << pack) - 1)) * size) & ((1 << size) - 1)
    return np.append(np.array(palette, np.int64), 0)[np.minimum(at, len(palette))].ravel().tolist()


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> np.ndarray:
    """An RGBA array (height, width, 4) of any lossless WebP file of at most ``most_pixels``."""
    bits = Bits(chunk_of(data))
    w, h = read_header(bits)
    if w * h > most_pixels:
        raise WebpError("more pixels than allowed")
    undo, now = [], w
    while bits.read(1):
        kind = bits.read(2)
        if kind in [k for k, *_ in undo]:
            raise WebpError("a transform twice")
        if kind < 2:
            block_bits = bits.read(3) + 2
            undo.append((kind, now, _read_pixels(bits, -(-now >> block_bits), -(-h >> block_bits), False), block_bits))
        elif kind == 2:
            undo.append((kind, now, None, 0))
        else:
            size = bits.read(8) + 1
            palette = _read_pixels(bits, size, 1, False)
            for i in range(1, size):
                palette[i] = _plus(palette[i], palette[i - 1])
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, now, palette, pack))
            now = -(-now >> pack)
    pixels = _read_pixels(bits, now, h, True)
    for kind, at, extra, k in reversed(undo):
        if kind == 0:
            pixels = undo_predictor(pixels, at, extra, k)
        elif kind == 1:
            pixels = undo_cross_colour(pixels, at, extra, k)
        elif kind == 2:
            pixels = [_plus(v, (v >> 8 & 255) * 0x00010001) for v in pixels]
        else:
            pixels = undo_palette(pixels, at, h, extra, k)
    v = np.array(pixels, np.uint32).reshape(h, w)
    return np.stack([v >> 16, v >> 8, v, v >> 24], axis=-1).astype(np.uint8)


def _plain(data: bytes) -> tuple | None:
    """Dimensions, code lengths and first data bit of a picture that can go side by side."""
    bits = Bits(chunk_of(data))
    w, h = read_header(bits)
    if bits.peek(3):  # a transform, a colour cache or meta codes
        return None
    bits.read(3)
    green, red, blue, alpha = (read_lengths(bits, n) for n in (280, 256, 256, 256))
    read_lengths(bits, 40)
    if green[256:].any() or np.count_nonzero(alpha) != 1 or max(green.max(), red.max(), blue.max()) > SIDE_BITS:
        return None
    return w, h, np.stack([green[:256], red, blue]), int(alpha.argmax()), bits


def _side_tables(lengths: np.ndarray) -> np.ndarray:
    """For rows of code lengths: symbol and length (times 256) by the next SIDE_BITS bits."""
    n = len(lengths)
    lone = np.count_nonzero(lengths, axis=1) == 1
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    own = np.take_along_axis(lengths, order, axis=1)
    spans = np.where(own > 0, 1 << (SIDE_BITS - own), 0)
    spans[lone] = 0
    spans[lone, 0] = 1 << SIDE_BITS
    own[lone] = 0
    if (spans.sum(axis=1) != 1 << SIDE_BITS).any():
        raise WebpError("an incomplete prefix code")
    entries = np.repeat((order + own * 256).ravel(), spans.ravel()).reshape(n, -1)
    out = np.empty_like(entries, np.uint16)
    out[:, _reversed(SIDE_BITS)] = entries
    return out


def _decode_side_by_side(plain: list[tuple]) -> list[np.ndarray]:
    counts = np.array([w * h for w, h, *_ in plain])
    order = np.argsort(-counts, kind="stable")
    plain = [plain[i] for i in order]
    counts = counts[order]
    lanes = len(plain)
    tables = _side_tables(np.concatenate([p[2] for p in plain])).ravel()
    base = np.arange(lanes, dtype=np.int64) * 3 << SIDE_BITS
    parts = [p[4].data for p in plain]
    starts = np.cumsum([0] + [len(x) for x in parts[:-1]])
    raw = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    words = np.ascontiguousarray(np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)))
    pos = starts * 8 + np.array([p[4].pos for p in plain])
    last = starts * 8 + np.array([p[4].end for p in plain])
    most = int(counts[0])
    out = np.empty((3, most, lanes), np.uint8)
    live = np.searchsorted(-counts, -np.arange(most), side="left")  # lanes with more than so many pixels
    mask = np.uint64((1 << SIDE_BITS) - 1)
    for k in range(most):
        n = int(live[k])
        p, b = pos[:n], base[:n]
        np.minimum(p, last[:n], out=p)
        v = words[p >> 3] >> (p & 7).astype(np.uint64)
        taken = 0
        for c in range(3):
            e = tables[b + (c << SIDE_BITS) + (v & mask).astype(np.int64)]
            size = e >> 8
            out[c, k, :n] = e & 255
            v >>= size.astype(np.uint64)
            taken = taken + size
        p += taken
    if (pos > last).any():
        raise WebpError("the data end early")
    found: list[np.ndarray] = [None] * lanes
    for lane, (w, h, _, alpha, _) in enumerate(plain):
        rgba = np.empty((h * w, 4), np.uint8)
        rgba[:, 0], rgba[:, 1], rgba[:, 2], rgba[:, 3] = out[1, : h * w, lane], out[0, : h * w, lane], out[2, : h * w, lane], alpha
        found[order[lane]] = rgba.reshape(h, w, 4)
    return found


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """:func:`decode` of each file."""
    plain = [_plain(f) for f in files]
    side = iter(_decode_side_by_side([p for p in plain if p]) if any(plain) else [])
    return [next(side) if p else decode(f) for p, f in zip(plain, files, strict=True)]


def code_lengths(counts: list[int], symbols: list[int]) -> dict[int, int]:
    """Huffman lengths of at most SIDE_BITS; flatter counts until they fit."""
    while True:
        heap = [(c, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        up, nxt = [0] * (2 * len(counts) - 1), len(counts)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            up[i] = up[j] = nxt
            heapq.heapreplace(heap, (a + b, nxt))
            nxt += 1
        depth = [0] * nxt
        for i in range(nxt - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth) <= SIDE_BITS:
            return dict(zip(symbols, depth, strict=False))
        counts = [c // 2 | 1 for c in counts]


#: Lengths of the code-length code that every stored picture uses: 3 bits for 8 to 10, 4 bits for the rest.
_OWN = np.array([4] * 8 + [3] * 3 + [0] * 6 + [4] * 2)


def _own_codes() -> dict[int, tuple[int, int]]:
    out, code = {}, 0
    for size in (3, 4):
        for s in np.flatnonzero(_OWN == size).tolist():
            out[s] = (int(f"{code:0{size}b}"[::-1], 2), size)
            code += 1
        code <<= 1
    return out


_OWN_CODES = _own_codes()


def _put(lengths: dict[int, int]) -> tuple[int, int]:
    """The bits of one prefix code's lengths, and how many; no symbol is written as one."""
    v = at = 0
    if not lengths:
        return 0b0001, 4
    if len(lengths) == 1:
        return 0b101 | next(iter(lengths)) << 3, 11
    tokens: list[tuple[int, int, int]] = []
    before = -1
    for s in sorted(lengths):
        gap = s - before - 1
        while gap:
            if gap >= 11:
                run = min(gap, 138)
                tokens.append((18, run - 11, 7))
            elif gap >= 3:
                run = gap
                tokens.append((17, run - 3, 3))
            else:
                run = 1
                tokens.append((0, 0, 0))
            gap -= run
        tokens.append((lengths[s], 0, 0))
        before = s
    v, at = 0 | (14 << 1), 5  # a normal code with 18 code-length codes
    for s in LENGTH_ORDER[:18]:
        v |= int(_OWN[s]) << at
        at += 3
    count = 8 if len(tokens) < 258 else 10
    v |= (1 | (count // 2 - 1) << 1 | (len(tokens) - 2) << 4) << at  # how many tokens, in 8 or 10 bits
    at += 4 + count
    for s, extra, n in tokens:
        bits, size = _OWN_CODES[s]
        v |= (bits | extra << size) << at
        at += size + n
    return v, at


class _Stream:
    """Bits written least significant first."""

    def __init__(self):
        self.out, self.hold, self.n = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        """The low ``n`` bits of a number."""
        self.hold |= value << self.n
        self.n += n
        if self.n > 4096:
            whole = self.n // 8
            self.out += (self.hold & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.hold >>= 8 * whole
            self.n -= 8 * whole

    def bytes(self) -> bytes:
        """All bits, zeros to the end of the last byte."""
        return bytes(self.out) + self.hold.to_bytes(-(-self.n // 8), "little")


def _codes_of(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes, reversed for writing; a lone symbol takes no bits."""
    if len(lengths) == 1:
        return {next(iter(lengths)): (0, 0)}
    out, code, last = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


def _prefix(amount: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance."""
    if amount <= 4:
        return amount - 1, 0, 0
    top = (amount - 1).bit_length() - 1
    second = (amount - 1) >> (top - 1) & 1
    return 2 * top + second, (amount - 1) & ((1 << top - 1) - 1), top - 1


def _references(pixels: list[int]) -> list[tuple[int, int]]:
    """The picture as (pixel, 0) literals and (distance, length) references: at each place the latest earlier place with the same three pixels."""
    out, seen, at, n = [], {}, 0, len(pixels)
    while at < n:
        key = tuple(pixels[at : at + 3])
        before, size = seen.get(key, -1) if len(key) == 3 else -1, 0
        if before >= 0:
            while at + size < n and size < LONGEST and pixels[before + size] == pixels[at + size]:
                size += 1
        step = size if size >= 3 else 1
        out.append((at - before, size) if size >= 3 else (pixels[at], 0))
        for k in range(at, min(at + step, at + 64)):  # the first places of a long reference will do
            seen[tuple(pixels[k : k + 3])] = k
        at += step
    return out


def _write_pixels(to: _Stream, pixels: list[int], w: int, spatial: bool, cached: bool) -> None:
    """One entropy-coded picture: references, and literals that the colour cache has by their place in it."""
    near = {}
    for k, (dx, dy) in enumerate(NEAR, 1):
        near.setdefault(max(1, dx + dy * w), k)
    cache = [0] * (1 << CACHE_BITS)
    symbols: list[tuple] = []  # (green symbol, further symbols by alphabet, extra bits)
    at = 0
    for a, size in _references(pixels) if spatial else [(v, 0) for v in pixels]:
        if size:
            length, far = _prefix(size), _prefix(near.get(a, a + 120))
            symbols.append((256 + length[0], ((4, far[0]),), (length[1:], far[1:])))
        else:
            slot = (0x1E35A7BD * a & 0xFFFFFFFF) >> (32 - CACHE_BITS)
            if cached and cache[slot] == a:
                symbols.append((280 + slot, (), ()))
            else:
                symbols.append((a >> 8 & 255, ((1, a >> 16 & 255), (2, a & 255), (3, a >> 24)), ()))
        if cached:
            for v in dict.fromkeys(pixels[at : at + max(size, 1)]) if size > 64 else pixels[at : at + max(size, 1)]:
                cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - CACHE_BITS)] = v
        at += max(size, 1)
    counts: list[dict[int, int]] = [{} for _ in range(5)]
    for green, more, _ in symbols:
        counts[0][green] = counts[0].get(green, 0) + 1
        for c, v in more:
            counts[c][v] = counts[c].get(v, 0) + 1
    to.put(1 | CACHE_BITS << 1 if cached else 0, 5 if cached else 1)
    if spatial:
        to.put(0, 1)  # one group of codes
    codes = []
    for own in counts:
        used = sorted(own)
        lengths = code_lengths([own[x] for x in used], used) if len(used) > 1 else dict.fromkeys(used, 0)
        if len(used) == 1 and used[0] > 255:
            lengths = {0: 1, used[0]: 1}  # a lone symbol has eight bits
        to.put(*_put(lengths))
        codes.append(_codes_of(lengths) if lengths else {})
    for green, more, extra in symbols:
        to.put(*codes[0][green])
        if extra:
            to.put(*extra[0])
        for c, v in more:
            to.put(*codes[c][v])
        if extra:
            to.put(*extra[1])


def _with_repeats(picture: np.ndarray) -> bytes:
    """The VP8L data of a picture that repeats itself: a palette of up to 256 colours, or the pixel above as predictor."""
    h, w, _ = picture.shape
    v = picture.astype(np.int64) @ np.array([1 << 16, 1 << 8, 1]) + BLACK
    colours, at = np.unique(v, return_inverse=True)
    to = _Stream()
    to.put(0x2F | (w - 1) << 8 | (h - 1) << 22, 40)
    if len(colours) <= 256:
        palette = colours.tolist()
        to.put(0b111, 3)
        to.put(len(palette) - 1, 8)
        steps = [sum(((a >> k & 255) - (b >> k & 255) & 255) << k for k in (0, 8, 16, 24)) for a, b in zip(palette, [0, *palette], strict=False)]
        _write_pixels(to, steps, len(palette), False, False)
        pack = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
        at = at.reshape(h, w)
        own = np.zeros((h, -(-w >> pack)), np.int64)
        for k in range(1 << pack):
            part = at[:, k :: 1 << pack]
            own[:, : part.shape[1]] |= part << k * (8 >> pack)
        to.put(0, 1)
        _write_pixels(to, (BLACK | own << 8).ravel().tolist(), own.shape[1], True, False)
    else:
        to.put(0b001, 3)
        to.put(4, 3)  # blocks of 64
        _write_pixels(to, [BLACK | 2 << 8] * (-(-w >> 6) * -(-h >> 6)), -(-w >> 6), False, False)
        parts = picture.astype(np.uint8)
        rest = parts.copy()
        rest[1:] -= parts[:-1]
        rest[0, 1:] -= parts[0, :-1]
        own = rest.astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])
        to.put(0, 1)
        _write_pixels(to, own.ravel().tolist(), w, True, True)
    return to.bytes()


def _filed(body: bytes) -> bytes:
    """A RIFF file around VP8L data."""
    pad = len(body) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + bytes(pad)


def encode_rgb(pictures: list[np.ndarray]) -> list[bytes]:
    """A WebP file for each (height, width, 3) picture; equal pictures, equal files.

    All are coded side by side as literals; those that a quick compressor finds full of
    repeats once more by :func:`_with_repeats`, and the smaller file stays.
    """
    n = len(pictures)
    flat = [p.reshape(-1, 3)[:, [1, 0, 2]].ravel() for p in pictures]  # green comes first
    sizes = np.array([len(x) for x in flat])
    at = np.repeat(np.arange(n, dtype=np.int32) * 256, sizes)
    at += np.concatenate(flat)
    hist = np.bincount(at, minlength=n * 256).reshape(n, 256)
    lengths, heads = np.zeros((n, 256), np.int64), []
    for i, (p, counts) in enumerate(zip(pictures, hist, strict=True)):
        used = np.flatnonzero(counts)
        own = code_lengths(counts[used].tolist(), used.tolist()) if len(used) > 1 else {int(used[0]): 0}
        lengths[i, list(own)] = list(own.values())
        h, w, _ = p.shape
        v, head = 0x2F | (w - 1) << 8 | (h - 1) << 22, 43  # no alpha, version, transform, cache, meta codes
        bits, size = _put(own)
        for _ in range(3):
            v |= bits << head
            head += size
        v |= (0b101 | 255 << 3) << head  # alpha is always 255
        head += 11
        v |= 0b0001 << head  # distances are never used
        head += 4
        heads.append((v, head))
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    own = np.take_along_axis(lengths, order, axis=1)
    spans = np.where(own > 0, 1 << (SIDE_BITS - own), 0)
    starts = np.cumsum(spans, axis=1) - spans
    codes = np.zeros((n, 256), np.int64)
    np.put_along_axis(codes, order, np.where(own > 0, _reversed(SIDE_BITS)[starts & ((1 << SIDE_BITS) - 1)], 0), axis=1)
    size, code = lengths.astype(np.uint8).ravel()[at], codes.astype(np.uint16).ravel()[at]
    ends = np.cumsum(size, dtype=np.int64)
    stream = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(size.max())):  # the k-th bit of every code that has one
        has = np.flatnonzero(size > k)
        stream[ends[has] - size[has] + k] = code[has] >> np.uint16(k) & np.uint16(1)
    out, upto = [], 0
    for (v, head), end in zip(heads, ends[np.cumsum(sizes) - 1].tolist(), strict=True):
        top = np.unpackbits(np.frombuffer(v.to_bytes(-(-head // 8), "little"), np.uint8), bitorder="little")[:head]
        body = np.packbits(np.concatenate([top, stream[upto:end]]), bitorder="little").tobytes()
        upto = end
        out.append(body)
    for i, p in enumerate(pictures):
        if p.size >= 3 * LEAST_PIXELS and REPEATS * len(zlib.compress(p.tobytes(), 1)) < p.size:
            out[i] = min(_with_repeats(p), out[i], key=len)
    return [_filed(body) for body in out]
