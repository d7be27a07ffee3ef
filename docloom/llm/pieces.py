"""SentencePiece segmentation sampled from the piece lattice, and its lossless decoding.

A text's lattice has an edge for every piece of a vocabulary that its characters spell (spaces as U+2581), and for every
character an edge of its bytes' fall-back pieces. Weights follow the pieces' ranks in the vocabulary (Zipf's law, to the
power ALPHA; the model of the tokenizer holds merge ranks and no probabilities). Forward filtering sums the weights of
all segmentations up to each place; backward sampling draws one piece after another from the end, so a segmentation
comes up in proportion to its weight. The draws are a counter-based hash of (seed, row key, number of the draw): the
same row gives the same segmentation wherever it is computed.

Between two characters that stand side by side in no piece (a letter and the next space, most often), every segmentation
has a cut, so the lattice falls apart into stretches there. The forward sums of a stretch are computed once for each distinct stretch;
the backward draws of all stretches of a batch run side by side in numpy along the cumulated weights of their edges.

Decoding joins the pieces' bytes and turns U+2581 back into spaces; a U+2581 of the text itself is always spelled in
bytes, so nothing is lost. Defined results: null gives null, the empty text no pieces. Rows with a null key share one
stream of draws. A stretch of more than LONG characters isn't kept: its forward sums are made once, block by block, and
the lattice of a block again as the draws come to it from the end, so that memory is 8 bytes for a character. Repeated rows give equal pieces; other columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, mix64, runs, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED, LONG, KEEP = 2.0, 1, 4096, 80_000
SPACE = "▁"
#: In the numbers of a text's characters, spaces are U+2581, and U+D800, which no text holds, stands for a U+2581 of the text.
_SPACE, _OWN = 0x2581, 0xD800
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 0x9E3779B1 + b * 0x85EBCA6B >> 9) & 0xFFFFF


class Vocabulary:
    """Pieces, weights and bytes of a model file, and the lattices of stretches seen so far."""

    def __init__(self, path: str = MODEL, alpha: float = ALPHA):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i))]
        # neighbours inside some piece; a collision of the hash joins more than need be, which is harmless
        self.joined = np.zeros(1 << 20, bool)
        for i in plain:
            c = np.array([ord(x) for x in names[i]])
            self.joined[_pair(c[:-1], c[1:])] = True
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        # a piece's rank: how many pieces are merged before it
        ranks = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        self.longest = max(len(names[i]) for i in plain)
        self.byte_log = -alpha * log(10.0 + n)
        self.bytes = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(SPACE, " ").encode() if i in ranks else b"" for i in range(n)]
        # pieces by a hash of their characters and length, with open addressing
        self.slots = np.full(1 << 17, -1, np.int32)
        self.keys, self.logs = np.zeros(1 << 17, np.uint64), np.full(n + 1, -np.inf, np.float32)  # the last for no piece
        for i in plain:
            h = 0
            for c in names[i]:
                h = (h * int(_BASE) + int(_MIX(ord(c)))) & _ALL
            h = int(mix64(np.array([h + len(names[i])], np.uint64))[0])
            k = h >> 47
            while self.slots[k] >= 0:
                k = (k + 1) & 0x1FFFF
            self.slots[k], self.keys[k], self.logs[i] = i, h, -alpha * log(10.0 + ranks[i])
        self.clear()

    def look(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, -1 for none."""
        at = (keys >> np.uint64(47)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.slots[at], -1)
        open_ = np.nonzero((out < 0) & (self.slots[at] >= 0))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) & 0x1FFFF
            here = at[open_]
            hit = (self.keys[here] == keys[open_]) & (self.slots[here] >= 0)
            out[open_[hit]] = self.slots[here[hit]]
            open_ = open_[~hit & (self.slots[here] >= 0)]
        return out

    def clear(self) -> None:
        """Nodes (first edge, is it a stretch's first) and edges (cumulated share, nodes back, piece) of the stretches seen."""
        self.end: dict[int, int] = {}  # hash of a stretch -> its last node
        self.first, self.root = np.zeros(0, np.int32), np.zeros(0, bool)
        self.cum, self.back, self.edge = np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        """The lattices of new stretches, side by side; those of like length together."""
        order, parts, nodes, edges = np.argsort(sizes, kind="stable"), [], len(self.root), len(self.cum)
        i = 0
        while i < len(order):
            size = int(sizes[order[i]])
            j = int(np.searchsorted(sizes[order], size + size // 8, side="right"))
            j = max(i + 1, min(j, i + 40_000 // (size + size // 8)))
            own = order[i:j]
            part = self._lattice(codes, starts[own], sizes[own])
            self.end.update(zip(hashes[own].tolist(), (nodes + sizes[own] * len(own) + np.arange(len(own))).tolist()))
            parts.append((part[0] + np.int32(edges), *part[1:]))
            nodes, edges, i = nodes + len(part[0]), edges + len(part[2]), j
        self.first, self.root, self.cum, self.back, self.edge = (np.concatenate([old, *(p[k] for p in parts)]) for k, old in enumerate((self.first, self.root, self.cum, self.back, self.edge)))

    def _lattice(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """n stretches of m characters at most: node v * n + s is place v of stretch s, its edges ordered from long to short."""
        n, m = len(starts), int(sizes.max())
        most = min(self.longest, m)
        inside = np.arange(m) < sizes[:, None]
        c = np.where(inside, codes[np.minimum(starts[:, None] + np.arange(m), len(codes) - 1)], 0)
        mixed, h = _MIX(c), np.zeros((n, m), np.uint64)
        weight, piece = np.full((m, n, most), -np.inf, np.float32), np.full((m, n, most), -1, np.int32)
        for size in range(1, most + 1):
            h = (h[:, :-1] if size > 1 else h) * _BASE + mixed[:, size - 1 :]
            found = self.look(mix64(h.ravel() + np.uint64(size))).reshape(h.shape)
            piece[size - 1 :, :, most - size] = found.T
            weight[size - 1 :, :, most - size] = self.logs[found].T
        within = inside.T
        bare = (piece < 0).all(2) & within
        if bare.any():
            lost = c.T[bare]
            known, at = np.unique(lost, return_inverse=True)
            weight[:, :, -1][bare] = (self.byte_log * np.array([len(_raw(int(k))) for k in known]))[at]
            piece[:, :, -1][bare] = -1 - lost.astype(np.int32)
        forward, cum = np.zeros((n, m + 1), np.float32), np.zeros((m, n, most), np.float32)
        for v in range(1, m + 1):
            k = min(most, v)
            terms = weight[v - 1, :, most - k :] + forward[:, v - k : v]
            top = np.maximum(terms.max(1), np.float32(-1e30))
            sums = np.cumsum(np.exp(terms - top[:, None]), 1, dtype=np.float32)
            total = np.maximum(sums[:, -1], np.float32(1e-30))
            cum[v - 1, :, most - k :] = sums / total[:, None]
            forward[:, v] = top + np.log(total)
        have = (weight > -np.inf) & within[:, :, None]
        flat = cum[have]
        per_node = np.concatenate([np.zeros(n, np.int64), have.sum(2).ravel()])
        first = np.cumsum(per_node) - per_node
        flat[(first + per_node - 1)[per_node > 0]] = 2.0
        back = np.broadcast_to(np.arange(most, 0, -1, dtype=np.int32) * np.int32(n), have.shape)[have]
        return first.astype(np.int32), np.arange((m + 1) * n) < n, flat, back, piece[have]


    def _ending(self, codes: np.ndarray, a: int, b: int) -> list[list[tuple[int, float, int]]]:
        """Of each place from a + 1 to b of a stretch: (nodes back, log weight, piece) of the edges that end there, from long to short."""
        low = max(0, a - self.longest + 1)
        c = codes[low:b]
        mixed, h, out = _MIX(c), np.zeros(len(c), np.uint64), [[] for _ in range(b - a)]
        hits = []
        for size in range(1, min(self.longest, len(c)) + 1):
            h = (h[:-1] if size > 1 else h) * _BASE + mixed[size - 1 :]
            skip = max(0, a + 1 - low - size)
            found = self.look(mix64(h[skip:] + np.uint64(size)))
            at = np.nonzero(found >= 0)[0]
            hits.append((size, (at + skip + low + size - a - 1).tolist(), found[at].tolist(), self.logs[found[at]].tolist()))
        for size, rows, pieces, logs in reversed(hits):
            for r, p, w in zip(rows, pieces, logs):
                out[r].append((size, w, p))
        for r, edges in enumerate(out):
            if not edges:
                code = int(codes[a + r])
                edges.append((1, self.byte_log * len(_raw(code)), -1 - code))
        return out

    def long_draw(self, codes: np.ndarray, stream: int, block: int = 0) -> np.ndarray:
        """The pieces of one stretch of any length, as `sample` draws them."""
        block, n = block or LONG, len(codes)
        forward = array("d", [0.0])
        for a in range(0, n, block):
            for v, edges in enumerate(self._ending(codes, a, min(n, a + block)), a + 1):
                terms = [w + forward[v - size] for size, w, _ in edges]
                top = max(terms)
                forward.append(top + log(sum([exp(t - top) for t in terms])))
        out, v, known, edges_of = array("q"), n, n, []
        while v:
            if not len(out) % 4096:
                turns = np.arange(len(out) + 1, len(out) + 4097, dtype=np.uint64) * _TURN
                draws = ((mix64(np.uint64(stream) ^ turns) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
            if v <= known:
                known = (v - 1) // block * block
                edges_of = self._ending(codes, known, min(n, known + block))
            edges, u, total = edges_of[v - known - 1], draws[len(out) % 4096], forward[v]
            share = 0.0
            for size, w, piece in edges:
                share += exp(w + forward[v - size] - total)
                if share > u:
                    break
            out.append(piece)
            v -= size
        return np.frombuffer(out, np.int64)[::-1]


_ALL = 2**64 - 1
_TURN = np.uint64(0xD1342543DE82EF95)


def _MIX(c):
    """A character's number, spread over 64 bits."""
    if isinstance(c, int):
        return (c + 1) * 0xBF58476D1CE4E5B9 & _ALL
    return (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)


_POWERS = np.cumprod(np.full(LONG, _BASE))


def _raw(code: int) -> bytes:
    return (SPACE if code == _OWN else chr(code)).encode("utf-8", "surrogatepass")


def sample(texts: list[str | None], keys: list, vocabulary: Vocabulary, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, piece ids) of one sampled segmentation of each text."""
    if len(vocabulary.end) > KEEP:
        vocabulary.clear()
    size = np.array([len(t) if t else 0 for t in texts])
    where = np.concatenate([[0], np.cumsum(size)])
    codes = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(codes):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
    space = codes == 32
    codes[codes == _SPACE] = _OWN
    codes[space] = _SPACE
    new = np.ones(len(codes), bool)
    new[1:] = ~vocabulary.joined[_pair(codes[:-1], codes[1:])]
    new[where[:-1][size > 0]] = True
    starts = np.nonzero(new)[0]
    local = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    sizes = np.diff(np.append(starts, len(codes)))
    hashes = mix64(np.add.reduceat(_MIX(codes) * _POWERS[np.minimum(local, LONG - 1)], starts) + sizes.astype(np.uint64))
    short, long = np.nonzero(sizes <= LONG)[0], np.nonzero(sizes > LONG)[0]
    seen, example, which = np.unique(hashes[short], return_index=True, return_inverse=True)
    end = vocabulary.end
    missing = np.array([k for k, h in enumerate(seen.tolist()) if h not in end], np.int64)
    if len(missing):
        at = short[example[missing]]
        vocabulary.add(codes, starts[at], sizes[at], seen[missing])
    cum, back, edge, root, first = vocabulary.cum, vocabulary.back, vocabulary.edge, vocabulary.root, vocabulary.first
    node = np.zeros(len(starts), np.int64)
    node[short] = np.array([end[h] for h in seen.tolist()], np.int64)[which]
    per_text = np.searchsorted(starts, where)
    own = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest(), "big") for k in keys], np.uint64)
    count = np.diff(per_text)
    stream = np.repeat(own, count) + (np.arange(len(starts)) - np.repeat(per_text[:-1], count)).astype(np.uint64) * _BASE
    live, drawn, steps = short, [], np.zeros(len(starts), np.int64)
    while len(live):
        turn = np.full(1, len(drawn) + 1, np.uint64) * _TURN
        u = (mix64(stream[live] ^ turn) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = first[node[live]]
        past = np.nonzero(cum[pick] <= u)[0]
        while len(past):
            pick[past] += 1
            past = past[cum[pick[past]] <= u[past]]
        drawn.append((live, edge[pick]))
        node[live] -= back[pick]
        steps[live] += 1
        live = live[~root[node[live]]]
    whole = [vocabulary.long_draw(codes[starts[k] : starts[k] + sizes[k]], int(stream[k])) for k in long.tolist()]
    steps[long] = [len(x) for x in whole]
    place = np.concatenate([[0], np.cumsum(steps)])
    out = np.zeros(place[-1], np.int64)
    for k, x in zip(long.tolist(), whole):
        out[place[k] : place[k + 1]] = x
    for k, (of, what) in enumerate(drawn):
        out[place[of + 1] - 1 - k] = what
    offsets = place[per_text]
    if (raw := out < 0).any():
        wide = np.ones(len(out), np.int64)
        known, at = np.unique(out[raw], return_inverse=True)
        spelled = [[vocabulary.byte[b] for b in _raw(-1 - int(c))] for c in known]
        wide[raw] = np.array([len(x) for x in spelled])[at]
        moved = np.concatenate([[0], np.cumsum(wide)])
        begin = moved[:-1][raw]
        out = np.repeat(out, wide)
        for k in range(4):  # a character has four bytes at most
            on = np.array([len(x) > k for x in spelled])[at]
            out[begin[on] + k] = np.array([x[k] if len(x) > k else 0 for x in spelled])[at[on]]
        offsets = moved[offsets]
    return offsets, out.astype(np.int32)


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    return b"".join(map(vocabulary.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(path, alpha)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """docs with the column `pieces` (ids of a sampled segmentation; null for a null text) added or replaced."""
    columns = [c for c in docs.columns if c != "pieces"]
    key_at, text_at = columns.index(id_col), columns.index(text_col)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model, alpha)
        for batch in batches:
            _, starts, ends = utf8(batch.column(text_at))
            for i, j in runs(starts, ends, 1 << 19):
                part = batch.slice(i, j - i)
                texts = part.column(text_at).to_pylist()
                offsets, ids = sample(texts, part.column(key_at).to_pylist(), own, seed)
                lists = pa.ListArray.from_arrays(pa.array([None if t is None else o for t, o in zip(texts, offsets.tolist())] + [int(offsets[-1])], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*columns, "pieces"])
        own.clear()  # the worker may live on in other stages

    return docs.select(columns).transform(in_arrow, segment, docs.select(columns).schema.add("pieces", T.ArrayType(T.IntegerType())))


def decoded(docs: DataFrame, pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """docs with the column `decoded` (the text of the pieces; null for null) added or replaced."""
    columns = [c for c in docs.columns if c != "decoded"]
    at = columns.index(pieces_col)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [None if x is None else decode(x, own) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*columns, "decoded"])

    return docs.select(columns).transform(in_arrow, join, docs.select(columns).schema.add("decoded", "string"))


def op2_piece_lattice(spark, sf_dir: str) -> DataFrame:
    """doc_id, the pieces, their number, and the digests of the text and of the decoded pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sha = lambda c: F.sha2(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), 256)
    found = encode(docs).select("doc_id", "pieces", sha(F.col("text")).alias("text_sha256"))
    return decoded(found).select("doc_id", "pieces", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "text_sha256", sha(F.col("decoded")).alias("decoded_sha256"))
