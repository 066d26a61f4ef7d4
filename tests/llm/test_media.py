"""The lossless WebP decoder against a small encoder of every feature, and the media operators."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from halyard.llm import webp


class Image(webp.Writer):
    """Writes the parts of a file one by one."""

    def code(self, lengths):
        used = np.flatnonzero(lengths)
        if len(used) == 1 and used[0] < 256:
            self.only(int(used[0]))
        else:
            self.lengths(lengths)

    def pixels(self, argb, width, main, cache_bits=0, references=False, meta=None):
        """Literals, cache hits and references in flat codes; `meta` = (bits, group of each block)."""
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(1 if meta else 0, 1)
            if meta:
                bits, blocks = meta
                self.put(bits - 2, 3)
                self.pixels((blocks.astype(np.uint32) << 8).ravel(), blocks.shape[1], False)
        green = 280 + (1 << cache_bits if cache_bits else 0)
        flat = {n: self.flat(n) for n in {green, 256, 40}}
        groups = int(meta[1].max()) + 1 if meta else 1
        for _ in range(groups):
            for n in (green, 256, 256, 256, 40):
                self.lengths(flat[n])
        codes = {n: webp.canonical(v) for n, v in flat.items()}
        say = lambda s, n: self.put(codes[n][s], int(flat[n][s]))
        cache, at = [None] * (1 << cache_bits), 0
        argb = argb.tolist()
        while at < len(argb):
            run = 0
            if references and at >= width:
                while at + run < len(argb) and argb[at + run] == argb[at + run - width] and run < 12:
                    run += 1
            if run >= 3:
                symbol, extra, more = (run - 1, 0, 0) if run <= 4 else (4, 1, run - 5) if run <= 6 else (5, 1, run - 7) if run <= 8 else (6, 2, run - 9)
                say(256 + symbol, green)
                self.put(more, extra)
                say(0, 40)  # the pixel above
                for p in argb[at: at + run]:
                    if cache_bits:
                        cache[(webp.CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
                at += run
                continue
            p = argb[at]
            slot = (webp.CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache[slot] == p:
                say(280 + slot, green)
            else:
                for n, v in ((green, p >> 8 & 255), (256, p >> 16 & 255), (256, p & 255), (256, p >> 24)):
                    say(v, n)
            if cache_bits:
                cache[slot] = p
            at += 1

    @staticmethod
    def flat(n):
        k = max(1, (n - 1).bit_length())
        short = (1 << k) - n
        return np.array([k - 1] * short + [k] * (n - short))

    def file(self, width, height):
        body = b"\x2f" + ((width - 1) | (height - 1) << 14 | 1 << 28).to_bytes(4, "little") + self.value.to_bytes((self.n + 7) // 8, "little")
        pad = body + b"\0" * (len(body) & 1)
        return b"RIFF" + (len(pad) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + pad


def picture(width, height, colours=None, seed=0):
    r = np.random.default_rng(seed)
    if colours:
        return r.choice(r.integers(0, 2**32, colours, dtype=np.uint64), (height, width)).astype(np.uint32)
    return r.integers(0, 2**32, (height, width), dtype=np.uint64).astype(np.uint32)


@pytest.mark.parametrize("cache_bits, references", [(0, False), (0, True), (4, False), (7, True)])
def test_literals_references_and_cache(cache_bits, references):
    x = picture(9, 11, 5)
    w = Image()
    w.put(0, 1)
    w.pixels(x.ravel(), 9, True, cache_bits, references)
    data = w.file(9, 11)
    assert np.array_equal(webp.decode(data), x)
    assert np.array_equal(webp.decode_many(data + data, [0, len(data)])[1], x.ravel())


def test_meta_codes():
    x = picture(10, 9)
    blocks = np.random.default_rng(1).integers(0, 3, (3, 3))
    w = Image()
    w.put(0, 1)
    w.pixels(x.ravel(), 10, True, meta=(2, blocks))
    assert np.array_equal(webp.decode(w.file(10, 9)), x)


def test_subtract_green_and_cross_colour():
    x = picture(8, 6)
    a, r, g, b = (webp.channels(x)[..., i].astype(np.int64) for i in range(4))
    factors = np.array([[0x00F31145, 0x00107F80]], np.uint32)  # (6 rows, 8 columns) in blocks of 4 by 8
    f = webp.channels(factors)[0][np.arange(8) >> 2].view(np.int8).astype(np.int64)
    signed = lambda v: ((v & 255) ^ 128) - 128
    # the encoder takes away what the decoder adds: from red, then from blue by the whole red
    r2 = (r - (f[None, :, 3] * signed(g) >> 5)) & 255
    b2 = (b - (f[None, :, 2] * signed(g) >> 5) - (f[None, :, 1] * signed(r) >> 5)) & 255
    assert np.array_equal(webp.undo_cross_colour(webp.joined(np.stack([a, r2, g, b2], -1)), np.repeat(factors, 2, 0), 2), x)
    green = webp.joined(np.stack([a, (r - g) & 255, g, (b - g) & 255], -1))
    w = Image()
    w.put(1, 1)
    w.put(2, 2)
    w.put(0, 1)
    w.pixels(green.ravel(), 8, True)
    assert np.array_equal(webp.decode(w.file(8, 6)), x)
    w = Image()
    w.put(1, 1)
    w.put(1, 2)
    w.put(1, 3)  # blocks of 8
    w.pixels(factors[0, :1], 1, False)
    w.put(0, 1)
    f = webp.channels(factors)[0, 0].view(np.int8).astype(np.int64)
    r2 = (r - (f[3] * signed(g) >> 5)) & 255
    b2 = (b - (f[2] * signed(g) >> 5) - (f[1] * signed(r) >> 5)) & 255
    w.pixels(webp.joined(np.stack([a, r2, g, b2], -1)).ravel(), 8, True)
    assert np.array_equal(webp.decode(w.file(8, 6)), x)


def predictions(x, mode):
    """What each mode predicts from the original pixels, by the format's words."""
    h, w, _ = x.shape
    flat = x.reshape(-1, 4).astype(int)
    out = np.zeros_like(flat)
    mean = lambda a, b: (a + b) // 2
    for i in range(h * w):
        row, col = divmod(i, w)
        if i == 0:
            out[i] = [255, 0, 0, 0]
            continue
        if row == 0 or col == 0:
            out[i] = flat[i - 1] if row == 0 else flat[i - w]
            continue
        left, top, right, corner = flat[i - 1], flat[i - w], flat[i - w + 1], flat[i - w - 1]
        grad = left + top - corner
        half = mean(left, top)
        out[i] = [np.array([255, 0, 0, 0]), left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right)),
                  left if abs(grad - left).sum() < abs(grad - top).sum() else top, np.clip(grad, 0, 255), np.clip([int(p) + int((int(p) - int(q)) / 2) for p, q in zip(half, corner, strict=True)], 0, 255)][mode]
    return out.reshape(x.shape)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    x = picture(7, 5, seed=mode)
    rest = webp.joined((webp.channels(x).astype(int) - predictions(webp.channels(x), mode)) & 255)
    w = Image()
    w.put(1, 1)
    w.put(0, 2)
    w.put(0, 3)
    w.pixels(np.full(4, mode << 8, np.uint32), 2, False)
    w.put(0, 1)
    w.pixels(rest.ravel(), 7, True)
    assert np.array_equal(webp.decode(w.file(7, 5)), x)


@pytest.mark.parametrize("colours", [2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    palette = np.sort(np.random.default_rng(colours).choice(2**32, colours, replace=False)).astype(np.uint32)
    index = np.random.default_rng(1).integers(0, colours, (6, 13))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, each = 1 << bits, 8 >> bits
    wide = -(-13 // per)
    packed = np.zeros((6, wide), np.uint32)
    for c in range(13):
        packed[:, c // per] |= (index[:, c] << (c % per * each)).astype(np.uint32)
    steps = webp.joined(np.diff(webp.channels(palette).astype(int), axis=0, prepend=0) & 255)
    w = Image()
    w.put(1, 1)
    w.put(3, 2)
    w.put(colours - 1, 8)
    w.pixels(steps, colours, False)
    w.put(0, 1)
    w.pixels((packed << 8).ravel(), wide, True)
    assert np.array_equal(webp.decode(w.file(13, 6)), palette[index])


def test_broken_files():
    w = Image()
    w.put(0, 1)
    w.pixels(picture(4, 4).ravel(), 4, True)
    data = w.file(4, 4)
    for bad in (b"RIFX" + data[4:], data[:20] + b"\x30" + data[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    with pytest.raises(ValueError):
        webp.decode(data[:4] + (40).to_bytes(4, "little") + data[8:60])


def padded(raw):
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def test_round_trip():
    rng = random.Random(0)
    raws = [b"", b"\0" * 64, b"\0" * 300, b"a" * 63, b"a" * 64, bytes(range(256)) * 70, b"\0" * 70_000, "é€😀".encode() * 50] + [bytes(rng.choice((0, 32, 97, rng.randrange(256))) for _ in range(rng.randrange(500))) for _ in range(60)]
    off = np.append(0, np.cumsum([len(r) for r in raws]))
    media, _ = webp.encode_many(np.frombuffer(b"".join(raws), np.uint8), off)
    for raw, m in zip(raws, media, strict=True):
        starts = webp.files_in(m)
        assert b"".join(webp.payload_of(p) for p in webp.decode_many(m, starts)) == padded(raw)
        assert b"".join(webp.payload_of(webp.decode(m, s).ravel()) for s in starts) == padded(raw)


def test_media_operators(spark):
    rows = [(1, "hello", 3), (2, None, 3), (3, "", 3), (1, "hello", 3), (None, "é" * 20_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, media int")
    got = webp.read_back(webp.encode(docs)).collect()
    assert len(got) == 5
    for r, (_, text, _) in ((r, next(x for x in rows if x[0] == r["doc_id"])) for r in got):
        raw = (text or "").encode()
        p = padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert webp.encode(docs.limit(0)).count() == 0


def test_pixels_operator(spark):
    docs = spark.createDataFrame([(1, "hello"), (2, None), (None, "é" * 20_000)], "doc_id bigint, text string")
    media = webp.encode(docs)
    read = {r["doc_id"]: r for r in webp.read_back(media).collect()}
    for r in webp.pixels(media).collect():
        assert all(len(i["argb"]) == i["width"] * i["height"] for i in r["images"])
        payload = b"".join(webp.payload_of(np.array(i["argb"], np.uint32)) for i in r["images"])
        assert hashlib.sha256(payload).hexdigest() == read[r["doc_id"]]["payload_sha256"]
    nothing = webp.pixels(spark.createDataFrame([(1, None)], "doc_id bigint, media binary")).first()
    assert nothing["images"] == []
