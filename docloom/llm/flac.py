"""Media columns: FLAC streams of 8-bit mono samples, written and read in numpy, many frames in lockstep.

A stream is a `fLaC` mark, STREAMINFO (with the samples' MD5), a SEEKTABLE with the first sample and byte offset of
every frame, and frames of BLOCK samples. Each frame is stored as the cheapest of: constant, verbatim, fixed predictors
of order 0 to 2, and a linear predictor of order LPC_ORDER (Levinson-Durbin on the autocorrelation, coefficients
quantised to LPC_BITS); residuals are Rice-coded with one parameter a frame. Headers carry CRC-8, frames CRC-16.

Reading checks the marks, every header's and frame's checksum, the seek table against the frames and the MD5, and undoes
Rice code and predictors for many frames at once, of all streams of a batch, sample by sample. `decode_range` reads some
samples by the seek table without the rest. Streams of other encoders go to `flac_reader`. `pcm_blocks` gives a media
column's samples as rows of PCM with their first sample.

A payload is the text's UTF-8 bytes, then bytes 0 up to a positive multiple of 64. Defined results: a null text is empty
(64 zero bytes); equal texts give equal streams; very long texts are coded CHUNK frames at a time, so that beside the text,
its stream and its samples little is held, and in blocks so large that the seek table holds all frames (512 samples up to
477 MB, then doubled); repeated rows are stored alike; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac_reader
from .common import in_arrow, runs, utf8

BLOCK, LPC_ORDER, LPC_BITS, LPC_SHIFT_MAX, RATE, PAD = 512, 4, 10, 9, 8000, 64
CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 32  # subframe types of the format
#: Frames coded at once, and seek points that the table's length can tell.
CHUNK, MAX_POINTS = 1024, ((1 << 24) - 1) // 18
SCHEMA = "id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_bytes long, media_sha256 string, feature string"


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table, top, mask = np.arange(256, dtype=np.uint32) << (bits - 8), 1 << (bits - 1), (1 << bits) - 1
    for _ in range(8):
        table = np.where(table & top, (table << 1) ^ poly, table << 1) & mask
    return table.astype(np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each part of data. Parts advance together, longest first, so that ended ones drop off the tail."""
    table, order = CRC8 if bits == 8 else CRC16, np.argsort(-sizes, kind="stable")
    at, n, crc = starts[order], sizes[order], np.zeros(len(sizes), np.uint16)
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for k, m in enumerate(live.tolist()):
        byte = data[at[:m] + k]
        crc[:m] = table[crc[:m] ^ byte] if bits == 8 else table[(crc[:m] >> 8) ^ byte] ^ (crc[:m] << 8)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    k = 2
    while n >> (5 * k + 1):
        k += 1
    return bytes([(0xFF00 >> k) & 0xFF | n >> (6 * (k - 1)), *[0x80 | (n >> (6 * j)) & 0x3F for j in range(k - 2, -1, -1)]])


def block_of(size: int) -> int:
    """Samples in a frame of a stream of this size: so many that the seek table can hold a point for each frame."""
    block = BLOCK
    while -(-size // block) > MAX_POINTS:
        block *= 2
    return block


def _headers(first: int, count: int, n: int, block: int) -> list[bytes]:
    """Headers of frames of n samples without CRC, numbered from `first`: 8 kHz, mono, 8 bits."""
    code, extra = (block.bit_length() - 1, b"") if n == block else (0x7, (n - 1).to_bytes(2, "big"))
    if n == block and block > 1 << 15:
        code, extra = 0x7, (n - 1).to_bytes(2, "big")
    return [bytes([0xFF, 0xF8, code << 4 | 0x4, 0x02]) + _number(k) + extra for k in range(first, first + count)]


def _levinson(x: np.ndarray, order: int) -> np.ndarray:
    """Quantised predictor coefficients of each row, and the shift of each: (rows, order + 1)."""
    w = x * np.hanning(x.shape[1] + 2)[1:-1].astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", w[:, k:], w[:, : x.shape[1] - k]) for k in range(order + 1)], 1).astype(np.float64)
    e, a = r[:, 0] * (1 + 1e-9) + 1e-6, np.zeros((len(x), order))
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / e
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        e = np.maximum(e * (1 - k * k), 1e-9)
    most = np.abs(a).max(1)
    shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(np.maximum(most, 1e-9) + 1e-12)), 0, LPC_SHIFT_MAX).astype(np.int64)
    q = np.clip(np.rint(a * 2.0 ** shift[:, None]), -(2 ** (LPC_BITS - 1)), 2 ** (LPC_BITS - 1) - 1)
    return np.concatenate([q, shift[:, None]], 1).astype(np.int32)


def _residuals(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    order = coef.shape[1] - 1
    guess = sum(coef[:, j, None] * x[:, order - 1 - j : x.shape[1] - 1 - j] for j in range(order))
    return x[:, order:] - (guess >> coef[:, -1, None])


def _rice(res: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zigzag values, best parameter, bits) of each row."""
    z = (res << 1) ^ (res >> 31)
    total = z.sum(1)
    guess = np.clip(np.floor(np.log2(np.maximum(total, 1) / max(1, z.shape[1]) + 1e-9)).astype(np.int32), 0, 13)
    bits = np.stack([(z >> (guess[:, None] + d)).sum(1, dtype=np.int64) + z.shape[1] * (1 + guess + d) for d in (0, 1)])
    pick = bits.argmin(0)
    return z, guess + pick, bits.min(0)


FIXED_COEF = {1: [1, 0], 2: [2, -1, 0]}


def _encode_frames(x: np.ndarray, headers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Frames of equal length n (rows of x, signed samples): (bytes of all, sizes)."""
    rows, n = x.shape
    plans: list = [(FIXED, 0, x, None)]
    for order, coef in FIXED_COEF.items():
        if n > order:
            plans.append((FIXED, order, _residuals(x, np.tile(np.array(coef, np.int32), (rows, 1))), None))
    if n > LPC_ORDER:
        coef = _levinson(x.astype(np.float32), LPC_ORDER)
        plans.append((LPC, LPC_ORDER, _residuals(x, coef), coef))
    coded = [_rice(p[2]) for p in plans]
    cost = np.stack([c[2] + 8 * p[1] + 10 + (9 + LPC_BITS * p[1] if p[0] == LPC else 0) for p, c in zip(plans, coded)])
    pick = cost.argmin(0)
    pick[cost.min(0) >= 8 * n] = -1
    pick[(x == x[:, :1]).all(1)] = -2
    head = np.array([len(h) + 1 for h in headers])
    body = np.where(pick == -2, 8, np.where(pick == -1, 8 * n, cost.min(0)))
    sizes = head + (8 + body + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    raw = np.frombuffer(b"".join(h + b"\0" for h in headers), np.uint8)
    data = np.zeros(int(sizes.sum()), np.uint8)
    within = np.arange(len(raw)) - np.repeat(np.cumsum(head) - head, head)
    data[np.repeat(starts, head) + within] = raw
    data[starts + head - 1] = _crcs(data, starts, head - 1, 8).astype(np.uint8)
    bits, windows = np.zeros(len(data) * 8, np.uint8), np.zeros(len(data))

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[at + b] = (value >> (width - 1 - b)) & 1

    at0 = (starts + head) * 8
    kind = np.where(pick == -2, CONSTANT, VERBATIM)
    for k, p in enumerate(plans):
        kind[pick == k] = p[0] + (p[1] if p[0] == FIXED else p[1] - 1)
    put(at0, kind << 1, 8)
    if (one := np.nonzero(pick == -2)[0]).size:
        put(at0[one] + 8, x[one, 0] & 255, 8)
    if (plain := np.nonzero(pick == -1)[0]).size:
        put((at0[plain] + 8)[:, None] + 8 * np.arange(n), x[plain] & 255, 8)
    for k, (what, order, _, coef) in enumerate(plans):
        if not (of := np.nonzero(pick == k)[0]).size:
            continue
        at = at0[of] + 8
        for j in range(order):
            put(at, x[of, j] & 255, 8)
            at = at + 8
        if what == LPC:
            put(at, np.full(len(of), LPC_BITS - 1), 4)
            put(at + 4, coef[of, -1], 5)
            at = at + 9
            for j in range(order):
                put(at, coef[of, j] & (2**LPC_BITS - 1), LPC_BITS)
                at = at + LPC_BITS
        z, par = coded[k][0][of], coded[k][1][of]
        put(at, par, 10)  # Rice method 0, partition order 0, then the parameter's four bits
        q = z >> par[:, None]
        length = q + 1 + par[:, None]
        stop = (at + 10)[:, None] + np.cumsum(length, 1) - length + q
        # the one and the low bits as a 24-bit window from their first byte on; no two codes share a bit, so sums are unions
        code = (1 << par)[:, None] | z & ((1 << par) - 1)[:, None]
        windows += np.bincount((stop >> 3).ravel(), (code << (23 - par[:, None] - (stop & 7))).ravel(), len(windows))
    data |= np.packbits(bits)
    w = windows.astype(np.int32)
    data |= (w >> 16).astype(np.uint8)
    data[1:] |= (w[:-1] >> 8).astype(np.uint8)
    data[2:] |= w[:-2].astype(np.uint8)
    crc = _crcs(data, starts, sizes - 2, 16)
    data[starts + sizes - 2], data[starts + sizes - 1] = (crc >> 8).astype(np.uint8), (crc & 255).astype(np.uint8)
    return data, sizes


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of 1 byte or more; a byte is the sample byte - 128."""
    jobs: dict[int, list[tuple[int, int, int]]] = {}  # samples in a frame -> (payload, first frame, frames)
    blocks = [block_of(len(p)) for p in payloads]
    for k, (p, block) in enumerate(zip(payloads, blocks)):
        for first in range(0, len(p) // block, CHUNK):
            jobs.setdefault(block, []).append((k, first, min(CHUNK, len(p) // block - first)))
        if len(p) % block:
            jobs.setdefault(len(p) % block, []).append((k, len(p) // block, 1))
    frames: list[list[tuple[int, bytes, list[int]]]] = [[] for _ in payloads]
    for n, todo in jobs.items():
        at = 0
        while at < len(todo):
            own, size = [], 0
            while at < len(todo) and (not own or size + todo[at][2] <= max(1, CHUNK * BLOCK // n)):
                own.append(todo[at])
                size += todo[at][2]
                at += 1
            x = b"".join([payloads[k][f * blocks[k] : f * blocks[k] + c * n] for k, f, c in own])
            headers = [h for k, f, c in own for h in _headers(f, c, n, blocks[k])]
            data, sizes = _encode_frames(np.frombuffer(x, np.uint8).reshape(-1, n).astype(np.int32) - 128, headers)
            raw, ends, done = data.tobytes(), np.concatenate([[0], np.cumsum(sizes)]).tolist(), 0
            for k, f, c in own:
                frames[k].append((f, raw[ends[done] : ends[done + c]], sizes[done : done + c].tolist()))
                done += c
    out = []
    for k, (p, block) in enumerate(zip(payloads, blocks)):
        own, frames[k] = sorted(frames[k]), []
        sizes = np.array([x for _, _, part in own for x in part], np.int64)
        info = block.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + _md5(p)
        points = np.zeros(len(sizes), _POINT)
        points["sample"] = np.arange(len(sizes)) * block
        points["offset"], points["n"] = np.cumsum(sizes) - sizes, np.minimum(block, len(p) - np.arange(len(sizes)) * block)
        out.append(b"".join([b"fLaC\x00", len(info).to_bytes(3, "big"), info, b"\x83", (18 * len(points)).to_bytes(3, "big"), points.tobytes(), *(raw for _, raw, _ in own)]))
    return out


def _md5(payload: bytes) -> bytes:
    digest = hashlib.md5()
    for k in range(0, len(payload), 1 << 20):
        digest.update(payload[k : k + (1 << 20)].translate(_SIGNED))
    return digest.digest()


_SIGNED = bytes((b - 128) & 255 for b in range(256))
_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])


class Other(ValueError):
    """A stream that another encoder may have made."""


def _open(media: bytes) -> tuple[int, bytes, np.ndarray, int, int]:
    """(samples, MD5, seek points, where frames begin, samples in a frame)."""
    info = flac_reader.stream_info(media)
    at, last, points = 4, False, np.zeros(0, _POINT)
    while not last:
        last, kind, size = bool(media[at] & 128), media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        if kind == 3 and not size % 18:
            points = np.frombuffer(media[at + 4 : at + 4 + size], _POINT)
        at += 4 + size
    total, block = info["total"], info["block"]
    if (info["bits"], info["channels"]) != (8, 1) or not block or total != int(points["n"].astype(np.int64).sum()) or (points["sample"] != np.arange(len(points)) * block).any() or (np.diff(points["offset"].astype(np.int64)) <= 0).any():
        raise Other("the seek table doesn't cover the samples")
    return total, info["md5"], points, at, block


def _decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray, numbers: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples (rows of `block`, rest 0) of frames at `starts`; every checksum and header is checked."""
    rows = len(starts)
    crc = _crcs(data, starts, sizes, 16)
    if crc.any():
        raise ValueError("a frame's checksum is wrong")
    byte = lambda k: data[starts + k].astype(np.int64)
    long = np.where(byte(4) < 0x80, 1, 0)
    for k in range(2, 8):
        long += np.where((byte(4) >> (7 - k)) == (1 << (k + 1)) - 2, k, 0)
    number = np.where(long == 1, byte(4), byte(4) & ((1 << np.maximum(7 - long, 0)) - 1))
    for k in range(1, int(long.max()) if rows else 0):
        number = np.where(long > k, number << 6 | data[np.minimum(starts + 4 + k, len(data) - 1)] & 0x3F, number)
    short = (byte(2) >> 4) == 7
    head = 4 + long + 2 * short
    n = np.where(short, (data[starts + 4 + long].astype(np.int64) << 8 | data[starts + 5 + long]) + 1, block)
    if (byte(1) != 0xF8).any() or ((byte(2) >> 4) != np.where(short, 7, block.bit_length() - 1)).any() or (byte(3) != 0x02).any():
        raise Other("another kind of frame")
    if (byte(0) != 0xFF).any() or (number != numbers).any() or (n != counts).any() or (_crcs(data, starts, head + 1, 8) != 0).any():
        raise ValueError("a frame's header is wrong")
    kind = data[starts + head + 1].astype(np.int64) >> 1
    if (data[starts + head + 1] & 1).any() or not np.isin(kind, [CONSTANT, VERBATIM, FIXED, FIXED + 1, FIXED + 2, LPC + LPC_ORDER - 1]).all():
        raise Other("another subframe")
    out, first = np.zeros((rows, block), np.int64), starts + head + 2
    signed = lambda v, w: v - ((v >> (w - 1)) << w)
    one = kind == CONSTANT
    out[one] = np.where(np.arange(block) < n[one, None], signed(data[first[one]].astype(np.int64), 8)[:, None], 0)
    if (plain := np.nonzero(kind == VERBATIM)[0]).size:
        at = np.minimum(first[plain, None] + np.arange(block), len(data) - 1)
        out[plain] = np.where(np.arange(block) < n[plain, None], signed(data[at].astype(np.int64), 8), 0)
    of = np.nonzero(kind >= FIXED)[0]
    if not of.size:
        return out
    of = of[np.argsort(-n[of], kind="stable")]
    words = np.concatenate([data, np.zeros(16, np.uint8)])
    # the eight bytes from any byte on, as one number
    big = np.lib.stride_tricks.as_strided(words.view(np.uint8), (len(data) + 8, 8), (1, 1))

    def peek(at: np.ndarray) -> np.ndarray:
        """57 bits or more from bit `at` on, left-aligned."""
        return np.ascontiguousarray(big[at >> 3]).view(">u8").ravel().astype(np.uint64) << (at & 7).astype(np.uint64)

    take = lambda at, w: (peek(at) >> np.uint64(64 - w)).astype(np.int64)
    lpc = kind[of] >= LPC
    order = np.where(lpc, kind[of] - LPC + 1, kind[of] - FIXED)
    at, most = first[of] * 8, int(order.max())
    x = np.zeros((len(of), block + most), np.int64)  # `most` zeros stand before the samples
    for j in range(most):
        have = order > j
        x[have, most + j] = signed(take(at[have], 8), 8)
        at[have] += 8
    coef, shift = np.zeros((len(of), max(len(FIXED_COEF), most)), np.int64), np.zeros(len(of), np.int64)
    for k, c in FIXED_COEF.items():
        rows_k = ~lpc & (order == k)
        coef[rows_k, :k] = c[:-1]
    if lpc.any():
        if (take(at[lpc], 4) != LPC_BITS - 1).any():
            raise Other("another precision of a predictor")
        shift[lpc] = take(at[lpc] + 4, 5)
        at[lpc] += 9
        for j in range(most):
            have = lpc & (order > j)
            coef[have, j] = signed(take(at[have], LPC_BITS), LPC_BITS)
            at[have] += LPC_BITS
    head10 = take(at, 10)
    if (head10 >> 4).any():
        raise Other("another residual code")
    if (head10 == 15).any():
        raise Other("escaped residuals")
    par, at, n_of = head10 & 15, at + 10, n[of]
    upar = par.astype(np.uint64)
    coef_t = np.ascontiguousarray(coef.T)
    xt = np.ascontiguousarray(x.T)  # a row a sample, so that each step works on contiguous memory
    live = np.searchsorted(-n_of, -np.arange(block), side="left")
    for t in range(block):
        m = int(live[t])
        if not m:
            break
        go = np.nonzero(order[:m] <= t)[0] if t < most else slice(0, m)
        pos = at[go]
        w = peek(pos)
        # zeros before the first one: 63 less the place of the highest bit, which the exponent of a double gives
        q = _zeros(w)
        if (q > 40).any():
            q = _long_zeros(peek, pos, q)
        pos = pos + q + 1
        w = w << np.minimum(q + 1, 63).astype(np.uint64)
        p = par[go]
        deep = q + 1 + p > 57
        if deep.any():
            w = np.where(deep, peek(pos), w)
        low = np.where(p > 0, (w >> (np.uint64(64) - np.maximum(upar[go], np.uint64(1)))).astype(np.int64), 0)
        at[go] = pos + p
        z = q << p | low
        guess = sum((coef_t[j][go] * xt[most + t - 1 - j][go] for j in range(most)), np.zeros(len(p), np.int64))
        xt[most + t][go] = ((z >> 1) ^ -(z & 1)) + (guess >> shift[go])
    out[of] = xt[most:].T
    return out


def _zeros(w: np.ndarray) -> np.ndarray:
    """Leading zero bits of each 64-bit word; 64 for zero."""
    high = (w >> np.uint64(32)).astype(np.float64)
    low = (w & np.uint64(0xFFFFFFFF)).astype(np.float64)
    exponent = lambda f: (f.view(np.int64) >> 52) - 1022  # noqa: E731  # bits of a positive whole number
    return np.where(high > 0, 32 - exponent(high), np.where(low > 0, 64 - exponent(low), 64))


def _long_zeros(peek, pos: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Lengths of unary codes that are longer than one look shows for sure: stepped over 32 zeros at a time."""
    q, skipped = q.copy(), np.zeros(len(pos), np.int64)
    while (far := q > 40).any():
        skipped[far] += 32
        q[far] = _zeros(peek(pos[far] + skipped[far]))
    return q + skipped


def _samples(media: bytes, head: tuple[int, bytes, np.ndarray, int, int], i: int, j: int) -> Iterator[bytes]:
    """The payload's bytes in frames i to j - 1 of a stream, some frames at a time."""
    _, _, points, at, block = head
    step = max(1, CHUNK * BLOCK // block)
    for a in range(i, j, step):
        b = min(j, a + step)
        begin = points["offset"][a:b].astype(np.int64)
        end = int(points["offset"][b]) if b < len(points) else len(media) - at
        yield _flat(media[at + int(begin[0]) : at + end], begin - begin[0], np.append(begin[1:], end) - begin, points["n"][a:b].astype(np.int64), np.arange(a, b), block)


def _flat(raw: bytes, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray, numbers: np.ndarray, block: int) -> bytes:
    samples = _decode_frames(np.frombuffer(raw, np.uint8), starts, sizes, counts, numbers, block)
    return (samples + 128).astype(np.uint8)[np.arange(block) < counts[:, None]].tobytes()


def decode(media: list[bytes]) -> list[bytes]:
    """The payloads of 8-bit mono streams; raises ValueError where a checksum or the samples' digest is wrong."""
    try:
        heads = [_open(m) for m in media]
        if all(len(h[2]) <= CHUNK and h[4] == BLOCK for h in heads):
            out = _decode_together(media, heads)
        else:
            out = [b"".join(_samples(m, h, 0, len(h[2]))) for m, h in zip(media, heads)]
    except Other:
        if len(media) > 1:
            return [decode([m])[0] for m in media]
        samples, info = flac_reader.read(media[0])
        if (info["bits"], info["channels"]) != (8, 1):
            raise ValueError("a payload is stored as 8-bit mono samples") from None
        return [(samples[0] + 128).astype(np.uint8).tobytes()]
    for payload, head in zip(out, heads):
        if len(payload) != head[0] or _md5(payload) != head[1]:
            raise ValueError("the samples' MD5 is wrong")
    return out


def _decode_together(media: list[bytes], heads: list) -> list[bytes]:
    """Short streams, as many at once as have CHUNK frames."""
    out, i = [], 0
    while i < len(media):
        j, frames = i, 0
        while j < len(media) and (j == i or frames + len(heads[j][2]) <= CHUNK):
            frames, j = frames + len(heads[j][2]), j + 1
        parts = [m[h[3] :] for m, h in zip(media[i:j], heads[i:j])]
        offset = np.cumsum([0, *map(len, parts)])
        starts = np.concatenate([o + h[2]["offset"].astype(np.int64) for o, h in zip(offset, heads[i:j])])
        ends = np.append(starts[1:], offset[-1])
        counts = np.concatenate([h[2]["n"].astype(np.int64) for h in heads[i:j]])
        flat, at = _flat(b"".join(parts), starts, ends - starts, counts, np.concatenate([np.arange(len(h[2])) for h in heads[i:j]]), BLOCK), 0
        for h in heads[i:j]:
            out.append(flat[at : at + h[0]])
            at += h[0]
        i = j
    return out


def decode_range(media: bytes, first: int, last: int) -> bytes:
    """Samples first to last - 1 of a stream, from the frames that hold them alone."""
    head = _open(media)
    total, block = head[0], head[4]
    last = min(last, total)
    if first >= last:
        return b""
    i, j = first // block, (last - 1) // block + 1
    return b"".join(_samples(media, head, i, j))[first - i * block : last - i * block]


def pcm_blocks(rows: DataFrame, id_col: str = "id", media_col: str = "media", size: int = 1 << 16) -> DataFrame:
    """(id, block, first_sample, n_samples, rate, channels, bits, pcm): the samples of a media column of FLAC streams of any
    encoder, `size` a row; `pcm` is interleaved and little-endian. A null stream has no rows; a broken one raises."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "block", "first_sample", "n_samples", "rate", "channels", "bits", "pcm"]
        for batch in batches:
            for k, media in enumerate(batch.column(1)):
                if not media.is_valid:
                    continue
                own = batch.column(0).slice(k, 1)
                data = media.as_py()
                info = flac_reader.stream_info(data)
                try:
                    (whole,) = decode([data]) if (info["bits"], info["channels"]) == (8, 1) else (None,)
                    whole = whole.translate(_SIGNED) if whole is not None else flac_reader.pcm(flac_reader.read(data)[0], info["bits"])
                except IndexError as e:
                    raise ValueError("the stream ends in a frame") from e
                step = info["channels"] * ((info["bits"] + 7) // 8)
                n = len(whole) // step
                for b, first in enumerate(range(0, n, size)):
                    m = min(size, n - first)
                    values = (b, first, m, info["rate"], info["channels"], info["bits"])
                    yield pa.RecordBatch.from_arrays([own, *(pa.array([v], pa.int64()) for v in values), pa.array([whole[first * step : (first + m) * step]], pa.binary())], names)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).transform(in_arrow, cut, f"id {kind}, block long, first_sample long, n_samples long, rate long, channels long, bits long, pcm binary")


def feature(payload: bytes) -> str:
    """Whole-number statistics of the samples as read back: mean and power in thousandths, zero crossings, peak."""
    total = power = crossings = peak = 0
    for k in range(0, len(payload), 1 << 18):
        x = np.frombuffer(payload[max(0, k - 1) : k + (1 << 18)], np.uint8).astype(np.int64) - 128
        crossings += int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
        x = x[min(k, 1) :]
        total, power, peak = total + int(x.sum()), power + int((x * x).sum()), max(peak, int(np.abs(x).max()))
    return f"mean={total * 1000 // len(payload)};power={power * 1000 // len(payload)};cross={crossings};peak={peak}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row a document: sizes and digests of the payload read back from its FLAC stream, and the stream itself."""
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = utf8(batch.column(1))
            for i, j in runs(starts, ends, 1 << 19):
                sizes = (ends[i:j] - starts[i:j]).tolist()
                media = encode([data[a:b].tobytes().ljust(max(PAD, -(-(b - a) // PAD) * PAD), b"\0") for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist())])
                back = decode(media)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(i, j - i), "n_bytes": pa.array(sizes, pa.int64()), "payload_bytes": pa.array(map(len, back), pa.int64()),
                    "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back], "tail_crc32": pa.array([zlib.crc32(b[-PAD:]) for b in back], pa.int64()),
                    "media": pa.array(media if keep_media else [None] * len(media), pa.binary()), "media_bytes": pa.array(map(len, media), pa.int64()),
                    "media_sha256": [hashlib.sha256(m).hexdigest() for m in media], "feature": list(map(feature, back)),
                })

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(in_arrow, store, SCHEMA.format(id=kind))


def op4_flac(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return media_columns(docs, keep_media=False).drop("media").withColumnRenamed("id", "doc_id")
