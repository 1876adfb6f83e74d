"""The WebP reader on streams written here, feature by feature."""

import struct

import numpy as np
import pytest

from brightquay.llm import webp


class Writer:
    """Bits, least significant first, and prefix codes of 8 and 9 bits."""

    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        """The low ``n`` bits."""
        self.bits += [value >> i & 1 for i in range(n)]

    def code(self, alphabet: int) -> dict[int, tuple[int, int]]:
        """Write a complete code for the alphabet and return its codes."""
        nine = 2 * (alphabet - 256)
        lengths = [8] * (alphabet - nine) + [9] * nine
        if nine > alphabet:
            lengths = [9] * alphabet
        self.put(0, 1)
        self.put(9, 4)  # 13 code-length codes
        for s in webp.LENGTH_ORDER[:13]:
            self.put(1 if s in (8, 9) else 0, 3)
        self.put(0, 1)
        for x in lengths:
            self.put(x - 8, 1)
        out, code, last = {}, 0, lengths[0]
        for s in sorted(range(alphabet), key=lambda i: (lengths[i], i)):
            code <<= lengths[s] - last
            last = lengths[s]
            out[s] = (int(f"{code:0{last}b}"[::-1], 2), last)
            code += 1
        return out

    def lone(self, symbol: int) -> dict[int, tuple[int, int]]:
        """A code of one symbol, which takes no bits."""
        self.put(0b101, 3)
        self.put(symbol, 8)
        return {symbol: (0, 0)}

    def forty(self) -> dict[int, tuple[int, int]]:
        """A code of the first two distance symbols."""
        self.put(0b0011, 3)
        self.put(0, 1)
        self.put(1, 8)
        return {0: (0, 1), 1: (1, 1)}

    def sym(self, code, s) -> None:
        """One symbol."""
        self.put(*code[s])

    def picture(self, pixels: list[int], spatial: bool) -> None:
        """Literals alone, without cache and meta codes."""
        self.put(0, 2 if spatial else 1)
        codes = [self.code(280), self.code(256), self.code(256), self.code(256), self.lone(0)]
        for v in pixels:
            for c, shift in zip(codes, (8, 16, 0, 24), strict=False):
                self.sym(c, v >> shift & 255)

    def file(self) -> bytes:
        """The RIFF file, with a chunk before the picture's."""
        body = np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        body += bytes(len(body) & 1)
        chunks = b"ABCD" + struct.pack("<I", 3) + b"xyz\0" + b"VP8L" + struct.pack("<I", len(body)) + body
        return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WEBP" + chunks


def start(w, h) -> Writer:
    """The header."""
    x = Writer()
    x.put(0x2F, 8)
    x.put(w - 1, 14)
    x.put(h - 1, 14)
    x.put(1, 1)
    x.put(0, 3)
    return x


def argb(a) -> list[int]:
    """Numbers of an RGBA array."""
    return [int(p[3]) << 24 | int(p[0]) << 16 | int(p[1]) << 8 | int(p[2]) for p in a.reshape(-1, 4)]


@pytest.fixture
def rgba():
    """A small picture."""
    return np.random.default_rng(1).integers(0, 256, (7, 9, 4)).astype(np.uint8)


def minus(a: int, b: int) -> int:
    """Difference by channel."""
    return sum(((a >> s & 255) - (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))


def test_literals(rgba):
    """No transform, all four channels."""
    x = start(9, 7)
    x.put(0, 1)
    x.picture(argb(rgba), True)
    assert np.array_equal(webp.decode(x.file()), rgba)


def test_predictors(rgba):
    """All sixteen modes; borders predict by themselves."""
    p, w = argb(rgba), 9
    modes = [(k % 16) << 8 | 0xFF000000 for k in range(6)]
    blocks = [0, 1, 2, 3, 4, 5]
    for shift in (0, 6, 10):
        modes = [((k + shift) % 16) << 8 | 0xFF000000 for k in blocks]
        x = start(9, 7)
        x.put(1, 1)
        x.put(0, 2)
        x.put(0, 3)  # blocks of 4
        x.picture(modes, False)
        x.put(0, 1)
        res = []
        for i, v in enumerate(p):
            y, c = divmod(i, w)
            guess = webp.BLACK if not i else p[i - 1] if not y else p[i - w] if not c else webp.predict((modes[(y >> 2) * 3 + (c >> 2)] >> 8) & 15, p[i - 1], p[i - w], p[i - w + 1], p[i - w - 1])
            res.append(minus(v, guess))
        x.picture(res, True)
        assert np.array_equal(webp.decode(x.file()), rgba)


def test_predictor_values():
    """Modes on numbers worked out by hand."""
    left, top, right, corner = 0x10203040, 0x20304050, 0x01020304, 0x10101010
    assert webp.predict(1, left, top, right, corner) == left and webp.predict(4, left, top, right, corner) == corner
    assert webp.predict(7, left, top, right, corner) == 0x18283848
    assert webp.predict(12, left, top, right, corner) == 0x20406080
    assert webp.predict(11, left, top, right, corner) == top
    assert webp.predict(13, left, top, right, corner) == 0x1C344C64


def test_cross_colour_and_green(rgba):
    """Both transforms, undone in reverse order."""
    signed = lambda v: v - 256 if v > 127 else v
    f = (200, 17, 130)  # red to blue, green to blue, green to red
    x = start(9, 7)
    x.put(1, 1)
    x.put(1, 2)
    x.put(3, 3)
    x.picture([0xFF << 24 | f[0] << 16 | f[1] << 8 | f[2]], False)
    x.put(1, 1)
    x.put(2, 2)
    x.put(0, 1)
    out = []
    for r, g, b, a in rgba.reshape(-1, 4).tolist():
        b2 = (b - (signed(f[1]) * signed(g) >> 5) - (signed(f[0]) * signed(r) >> 5)) & 255
        r2 = (r - (signed(f[2]) * signed(g) >> 5)) & 255
        out.append(a << 24 | ((r2 - g) & 255) << 16 | g << 8 | (b2 - g) & 255)
    x.picture(out, True)
    assert np.array_equal(webp.decode(x.file()), rgba)


@pytest.mark.parametrize(("size", "pack"), [(2, 3), (4, 2), (16, 1), (17, 0)])
def test_palette(size, pack):
    """Indices packed by the palette's size; an index beyond it is transparent black."""
    rng = np.random.default_rng(size)
    palette = rng.integers(0, 1 << 32, size).tolist()
    k = rng.integers(0, size, (5, 11))
    x = start(11, 5)
    x.put(1, 1)
    x.put(3, 2)
    x.put(size - 1, 8)
    x.picture([palette[0], *(minus(b, a) for a, b in zip(palette, palette[1:], strict=False))], False)
    x.put(0, 1)
    per, bits = 1 << pack, 8 >> pack
    rows = []
    for row in k.tolist():
        for c in range(0, 11, per):
            rows.append(0xFF000000 | sum(v << (i * bits) for i, v in enumerate(row[c : c + per])) << 8)
    x.picture(rows, True)
    assert argb(webp.decode(x.file())) == [palette[i] for i in k.ravel()]


def test_references_cache_and_meta_codes():
    """A colour cache, copies by near and plain distance, and two groups of codes."""
    x = start(16, 8)
    x.put(0, 1)
    x.put(1, 1)
    x.put(4, 4)  # a cache of 16 colours
    x.put(1, 1)
    x.put(0, 3)  # groups by blocks of 4
    x.picture([0xFF000000 | (g << 8) for g in (0, 1, 0, 1, 1, 0, 1, 0)], False)
    groups = [[x.code(296), x.code(256), x.code(256), x.lone(255), x.forty()] for _ in range(2)]
    want, colours = [], [0xFF102030, 0xFF405060, 0xFF708090]
    group = lambda: groups[(len(want) // 16 // 4 * 4 + len(want) % 16 // 4) % 2 ^ (len(want) // 64)]

    def literal(v):
        g = group()
        for c, shift in zip(g, (8, 16, 0), strict=False):
            x.sym(c, v >> shift & 255)
        want.append(v)

    for i in range(20):
        literal(colours[i % 3])
    v = want[-1]
    x.sym(group()[0], 280 + ((0x1E35A7BD * v & 0xFFFFFFFF) >> 28))
    want.append(v)
    g = group()
    x.sym(g[0], 256 + 4)  # length 5 or 6
    x.put(1, 1)
    x.sym(g[4], 0)  # distance code 1: the pixel above
    for _ in range(6):
        want.append(want[-16])
    g = group()
    x.sym(g[0], 256 + 2)  # length 3
    x.sym(g[4], 1)  # distance code 2: the pixel before
    for _ in range(3):
        want.append(want[-1])
    while len(want) < 128:
        literal(colours[len(want) % 3])
    assert argb(webp.decode(x.file())) == want


def test_side_by_side_equals_one_by_one():
    """The batch reader and the full one agree, lone symbols and noise included."""
    rng = np.random.default_rng(4)
    pictures = [rng.integers(97, 110, (h, 64, 3)).astype(np.uint8) for h in (1, 5, 64)] + [np.full((2, 64, 3), 32, np.uint8), rng.integers(0, 256, (64, 64, 3)).astype(np.uint8), np.array([[[1, 2, 1]] * 3], np.uint8)]
    files = webp.encode_rgb(pictures)
    for p, f, got in zip(pictures, files, webp.decode_many(files), strict=True):
        assert np.array_equal(got[:, :, :3], p) and (got[:, :, 3] == 255).all() and np.array_equal(webp.decode(f), got)
    assert webp.encode_rgb(pictures[::-1])[::-1] == files


def test_broken_files():
    """Errors are the reader's own."""
    f = webp.encode_rgb([np.zeros((1, 64, 3), np.uint8) + np.arange(64, dtype=np.uint8)[None, :, None]])[0]
    for bad in (b"", b"RIFFxxxxWEBP", f[:30]):
        with pytest.raises(webp.WebpError):
            webp.decode(bad)


def repeating(kind, rng):
    """Pictures that repeat themselves, in several ways."""
    if kind == "few colours":
        return rng.integers(0, 2, (40, 64, 1)).repeat(3, axis=2).astype(np.uint8)[np.arange(40) % 3]
    if kind == "words":
        return np.frombuffer(b"word " * 3000, np.uint8)[: 64 * 64 * 3].reshape(64, 64, 3)
    if kind == "rows":
        return np.tile(rng.integers(0, 256, (1, 64, 3)).astype(np.uint8), (64, 1, 1))
    return np.tile(rng.integers(0, 256, (8, 64, 3)).astype(np.uint8), (8, 1, 1))


@pytest.mark.parametrize("kind", ["few colours", "words", "rows", "many colours"])
def test_repeats_are_written_and_read(kind):
    """Such files hold transforms and references, are smaller than literals, and come back as they were."""
    p = repeating(kind, np.random.default_rng(4))
    file = webp.encode_rgb([p])[0]
    assert webp._plain(file) is None and len(file) < p.size // 3
    for got in (webp.decode(file), webp.decode_many([file, file])[1]):
        assert np.array_equal(got[:, :, :3], p) and (got[:, :, 3] == 255).all()


def test_documents_use_both_ways(spark):
    """Texts that repeat go through references, others side by side; payloads come back."""
    from brightquay.llm import media

    payloads = [b"word " * 2000 + b"\0" * 80, bytes(np.random.default_rng(2).integers(32, 127, 9600).astype(np.uint8))]
    payloads = [x + b" " * (-len(x) % 192) for x in payloads]
    stored = media.store(payloads)
    kinds = [[webp._plain(f) is None for f in media.split_files(x)] for x in stored]
    assert all(kinds[0]) and not any(kinds[1])
    assert [np.ascontiguousarray(x[:, :, :3]).tobytes() for x in media.read(stored)] == payloads


def test_media_files_are_bounded(spark):
    """A file may not declare more pixels than allowed; broken and missing ones give nulls."""
    from brightquay.llm import media

    small = webp.encode_rgb([np.full((8, 8, 3), 7, np.uint8)])[0]
    df = spark.createDataFrame([("a", bytearray(small)), ("b", bytearray(b"RIFF")), ("c", None)], "path string, content binary")
    got = {r.path: (r.height, r.width) for r in media.read_media(df).collect()}
    assert got == {"a": (8, 8), "b": (None, None), "c": (None, None)}
    assert media.read_media(df, most_pixels=63).filter("height IS NOT NULL").count() == 0
