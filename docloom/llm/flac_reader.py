"""Any FLAC stream, frame by frame: what `flac` does fast for its own streams, this does for those of other encoders.

Read are all subframe types (constant, verbatim, fixed predictors to order 4, linear predictors of any order and precision),
wasted bits, both Rice codes with partitions and escapes, up to 8 channels with left/side, side/right and mid/side, 4 to
32 bits, blocks of fixed or varying size. Header and frame checksums and the MD5 of the samples are checked; a frame that
fails raises ValueError. Seek points aren't needed, and placeholders among them are passed over.
"""

from __future__ import annotations

import hashlib

import numpy as np

# Fixed values of the format
BLOCKS = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
RATE_BYTES = {12: 1, 13: 2, 14: 2}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def checksum(data: bytes, poly: int, bits: int) -> int:
    crc, top, mask = 0, 1 << (bits - 1), (1 << bits) - 1
    for byte in data:
        crc ^= byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc & top else crc << 1) & mask
    return crc


class _Bits:
    """Bits of some bytes from the highest on."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise ValueError("the stream ends in a frame")
        self.at += n
        return int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at) & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        """The zeros before the next one, which is taken too."""
        n = 0
        while True:
            first, here = self.at >> 3, self.at & 7
            part = self.data[first : first + 8]
            if not part:
                raise ValueError("the stream ends in a frame")
            left = len(part) * 8 - here
            v = int.from_bytes(part, "big") & (1 << left) - 1
            if v:
                k = left - v.bit_length()
                self.at += k + 1
                return n + k
            n, self.at = n + left, self.at + left


def stream_info(media: bytes) -> dict:
    """Of STREAMINFO: rate, channels, bits, total, md5; `frames`: where they begin."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, out = 4, False, {}
    while not last:
        if at + 4 > len(media):
            raise ValueError("the stream ends in its metadata")
        last, kind, size = bool(media[at] & 128), media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            out = {"rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "total": v & (1 << 36) - 1, "md5": body[18:34], "block": int.from_bytes(body[:2], "big")}
        at += 4 + size
    if not out:
        raise ValueError("a stream without STREAMINFO")
    return out | {"frames": at}


def _residual(bits: _Bits, n: int, order: int) -> list[int]:
    method = bits.take(2)
    if method > 1:
        raise ValueError("an unknown residual code")
    width, parts, out = 4 + method, 1 << bits.take(4), []
    if n % parts or n // parts < order:
        raise ValueError("partitions don't fit the block")
    for k in range(parts):
        size, par = n // parts - (0 if k else order), bits.take(width)
        if par == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(size)]
            continue
        for _ in range(size):
            z = bits.zeros() << par | bits.take(par)
            out.append(z >> 1 ^ -(z & 1))
    return out


def _subframe(bits: _Bits, n: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("a subframe's padding isn't zero")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
    depth -= wasted
    if kind == 0:
        x = [bits.signed(depth)] * n
    elif kind == 1:
        x = [bits.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order, shift = (kind - 8, 0) if kind < 32 else (kind - 31, 0)
        if order > n:
            raise ValueError("a predictor is longer than its block")
        x, coef = [bits.signed(depth) for _ in range(order)], FIXED[order] if kind < 32 else []
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("an unknown predictor")
            coef = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, n, order):
            x.append(r + (sum([c * v for c, v in zip(coef, reversed(x[-order:] if order else []))]) >> shift))
    else:
        raise ValueError("an unknown subframe")
    return np.array(x, np.int64) << wasted


def _frame(media: bytes, at: int, info: dict) -> tuple[np.ndarray, int]:
    """(samples: channels x n, where the next frame begins)."""
    bits = _Bits(media, at)
    if bits.take(15) != 0x7FFC:
        raise ValueError("no frame where one should be")
    bits.take(1)
    size, rate, layout, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    lead = bits.take(8)
    bits.at += 8 * max(0, 8 - (lead ^ 255).bit_length() - 1)  # the rest of the frame's or sample's number
    n = bits.take(8) + 1 if size == 6 else bits.take(16) + 1 if size == 7 else BLOCKS.get(size, 0)
    bits.at += 8 * RATE_BYTES.get(rate, 0)
    head = bits.at >> 3
    if not n or checksum(media[at:head], 0x07, 8) != bits.take(8):
        raise ValueError("a frame's header is wrong")
    depth = BITS.get(depth, info["bits"])
    if layout < 8:
        x = [_subframe(bits, n, depth) for _ in range(layout + 1)]
    elif layout < 11:
        a, b = _subframe(bits, n, depth + (layout == 9)), _subframe(bits, n, depth + (layout != 9))
        if layout == 8:
            x = [a, a - b]
        elif layout == 9:
            x = [a + b, b]
        else:
            mid = a << 1 | b & 1
            x = [mid + b >> 1, mid - b >> 1]
    else:
        raise ValueError("an unknown layout of channels")
    end = bits.at + 7 >> 3
    if checksum(media[at:end], 0x8005, 16) != int.from_bytes(media[end : end + 2], "big"):
        raise ValueError("a frame's checksum is wrong")
    return np.stack(x), end + 2


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples of whole bytes, as the MD5 takes them."""
    width = (bits + 7) // 8
    return np.ascontiguousarray(samples.T).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def read(media: bytes) -> tuple[np.ndarray, dict]:
    """(samples: channels x n, stream_info)."""
    info, parts = stream_info(media), []
    at = info["frames"]
    while at < len(media):
        x, at = _frame(media, at, info)
        parts.append(x)
    samples = np.concatenate(parts, 1) if parts else np.zeros((info["channels"], 0), np.int64)
    if info["total"] and samples.shape[1] != info["total"]:
        raise ValueError("the stream has another number of samples")
    if any(info["md5"]) and hashlib.md5(pcm(samples, info["bits"])).digest() != info["md5"]:
        raise ValueError("the samples' MD5 is wrong")
    return samples, info
