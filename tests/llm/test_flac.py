"""FLAC streams written bit by bit, by the format's description alone: none of the encoder's code is used."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from docloom.llm import flac, flac_reader


def crc(data, poly, bits):
    v = int.from_bytes(data, "big") << bits
    for k in range(v.bit_length() - 1, bits - 1, -1):
        if v >> k & 1:
            v ^= (poly | 1 << bits) << (k - bits)
    return v


class Writer:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value & (1 << n) - 1, f"0{n}b") if n else ""

    def done(self):
        self.text += "0" * (-len(self.text) % 8)
        return bytes(int(self.text[k : k + 8], 2) for k in range(0, len(self.text), 8))


COEF = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def residual(w, res, order, n, parts, method):
    w.put(method, 2), w.put(parts, 4)
    at = 0
    for k in range(1 << parts):
        size = (n >> parts) - (0 if k else order)
        part, width = res[at : at + size], 4 + method
        at += size
        if k % 3 == 1:  # an escape: plain numbers
            raw = max([0, *(int(r).bit_length() + 1 for r in part)])
            w.put((1 << width) - 1, width), w.put(raw, 5)
            for r in part:
                w.put(r, raw)
            continue
        par = min((1 << width) - 2, max([0, *(int(abs(r)).bit_length() - 2 for r in part)]) + k % 2)
        w.put(par, width)
        for r in part:
            z = r << 1 if r >= 0 else (-r << 1) - 1
            w.text += "0" * (z >> par) + "1"
            w.put(z, par)


def subframe(w, x, depth, kind, parts, method, wasted=0):
    n = len(x)
    w.put(0, 1)
    x, depth = [v >> wasted for v in x], depth - wasted
    code = {"constant": 0, "verbatim": 1, "fixed": 8 + kind[-1], "lpc": 31 + kind[-1]}[kind[0]] if len(kind) > 1 else ["constant", "verbatim"].index(kind[0])
    w.put(code, 6), w.put(1 if wasted else 0, 1)
    if wasted:
        w.text += "0" * (wasted - 1) + "1"
    if kind[0] == "constant":
        return w.put(x[0], depth)
    if kind[0] == "verbatim":
        return [w.put(v, depth) for v in x]
    order = kind[1]
    for v in x[:order]:
        w.put(v, depth)
    coef, shift = (COEF[order], 0) if kind[0] == "fixed" else ([(-1) ** k * (900 - 100 * k) for k in range(order)], 9)
    if kind[0] == "lpc":
        w.put(12 - 1, 4), w.put(shift, 5)
        for c in coef:
            w.put(c, 12)
    res = [x[t] - (sum(c * x[t - 1 - j] for j, c in enumerate(coef)) >> shift) for t in range(order, n)]
    residual(w, res, order, n, parts, method)


def frame(number, channels, depth, layout, kinds, parts, method, wasted=0):
    n, w = len(channels[0]), Writer()
    w.put(0x3FFE, 14), w.put(0, 2), w.put(7, 4), w.put(0, 4), w.put(layout, 4), w.put(0, 3), w.put(0, 1)
    w.put(number, 8), w.put(n - 1, 16)
    w.put(crc(w.done(), 0x07, 8), 8)
    a, b = channels[0], channels[-1]
    own = {8: [(a, 0), ([x - y for x, y in zip(a, b)], 1)], 9: [([x - y for x, y in zip(a, b)], 1), (b, 0)], 10: [([x + y >> 1 for x, y in zip(a, b)], 0), ([x - y for x, y in zip(a, b)], 1)]}.get(layout, [(c, 0) for c in channels])
    for (x, more), kind in zip(own, kinds):
        subframe(w, x, depth + more, kind, parts, method, wasted)
    data = w.done()
    return data + crc(data, 0x8005, 16).to_bytes(2, "big")


def stream(frames, channels, depth, block, extra=b""):
    width = (depth + 7) // 8
    raw = b"".join(int(v).to_bytes(width, "little", signed=True) for row in zip(*channels) for v in row)
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | len(channels) - 1 << 41 | depth - 1 << 36 | len(channels[0])).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC" + (b"\x00" if extra else b"\x80") + len(info).to_bytes(3, "big") + info + extra + b"".join(frames), raw


def wave(rng, n, depth):
    top, x, v = (1 << (depth - 1)) - 1, [], 0
    for _ in range(n):
        v = max(-top, min(top, v + rng.randint(-top // 20 - 1, top // 20 + 1)))
        x.append(v)
    return x


CASES = [
    (8, 1, 0, [("fixed", 3)], 2, 0, 0), (8, 1, 0, [("fixed", 4)], 0, 0, 0), (8, 1, 0, [("lpc", 7)], 3, 1, 0), (8, 1, 0, [("verbatim",)], 0, 0, 2), (16, 1, 0, [("fixed", 0)], 1, 1, 0),
    (16, 2, 1, [("lpc", 2), ("fixed", 1)], 2, 0, 0), (16, 2, 8, [("fixed", 2), ("lpc", 12)], 1, 0, 0), (16, 2, 9, [("fixed", 3), ("verbatim",)], 0, 0, 0), (24, 2, 10, [("lpc", 4), ("fixed", 4)], 4, 1, 0), (12, 3, 2, [("fixed", 2), ("lpc", 1), ("constant",)], 1, 0, 3),
]


@pytest.mark.parametrize("case", CASES)
def test_streams_of_other_encoders(case):
    depth, n_channels, layout, kinds, parts, method, wasted = case
    rng = random.Random(str(case))
    channels = [[v << wasted for v in wave(rng, 96 * 3, depth - wasted)] for _ in range(n_channels)]
    if kinds[-1] == ("constant",):
        channels[-1] = [5 << wasted] * len(channels[-1])
    frames = [frame(k, [c[k * 96 : k * 96 + 96] for c in channels], depth, layout, kinds, parts, method, wasted) for k in range(3)]
    placeholder = b"\x83" + (18).to_bytes(3, "big") + b"\xff" * 8 + bytes(10)
    media, raw = stream(frames, channels, depth, 96, placeholder)
    samples, info = flac_reader.read(media)
    assert samples.tolist() == channels and info["rate"] == 44100 and flac_reader.pcm(samples, depth) == raw
    if (depth, n_channels) == (8, 1):
        assert flac.decode([media])[0] == bytes(v + 128 for v in channels[0])
    broken = bytearray(media)
    broken[-9] ^= 4
    with pytest.raises(ValueError):
        flac_reader.read(bytes(broken))
    with pytest.raises(ValueError):
        flac_reader.read(media[:-5])


def test_own_streams_are_plain_flac():
    rng = random.Random(4)
    payloads = [bytes(rng.choice(b"abc de") for _ in range(64 * k)) for k in (1, 7, 8, 9, 40)] + [bytes(64), bytes(rng.randrange(256) for _ in range(1024))]
    for p, m in zip(payloads, flac.encode(payloads)):
        assert (flac_reader.read(m)[0][0] + 128).astype(np.uint8).tobytes() == p


def test_pcm_blocks(spark):
    rng = random.Random(5)
    payload = bytes(rng.choice(b"abc de") for _ in range(6400))
    stereo = [wave(rng, 96, 16), wave(rng, 96, 16)]
    other, raw = stream([frame(0, stereo, 16, 10, [("fixed", 1), ("lpc", 3)], 1, 0)], stereo, 16, 96)
    rows = spark.createDataFrame([(1, bytearray(flac.encode([payload])[0]), "x"), (2, bytearray(other), "y"), (3, None, None)], "id long, media binary, block string")
    got = flac.pcm_blocks(rows, size=1000).collect()
    assert [(r.block, r.first_sample, r.n_samples) for r in got if r.id == 1] == [(k, 1000 * k, min(1000, 6400 - 1000 * k)) for k in range(7)]
    assert b"".join(bytes(r.pcm) for r in got if r.id == 1) == bytes((b - 128) & 255 for b in payload)
    (r,) = [r for r in got if r.id == 2]
    assert bytes(r.pcm) == raw and (r.rate, r.channels, r.bits, r.n_samples) == (44100, 2, 16, 96)


def test_long_payloads(monkeypatch):
    text = (b"Some words of a text, and some more. " * 400_000)[: 6_000_000]
    tracemalloc.start()
    media = flac.encode([text])
    assert flac.decode(media) == [text] and flac.feature(text).startswith("mean=")
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 150e6  # of which text, stream and samples are 18
    assert flac.decode_range(media[0], 5_000_123, 5_001_000) == text[5_000_123:5_001_000]
    monkeypatch.setattr(flac, "MAX_POINTS", 50)
    short = text[:300_000]
    (media,) = flac.encode([short])
    assert flac.block_of(len(short)) == 8192 and flac.decode([media, media]) == [short, short] and flac.decode_range(media, 9_000, 20_000) == short[9_000:20_000]
    assert (flac_reader.read(media)[0][0] + 128).astype(np.uint8).tobytes() == short and zlib.crc32(short[-64:]) == zlib.crc32(flac.decode([media])[0][-64:])
