"""Suffix-array dedup: the bytes covered by a string of LENGTH bytes that starts earlier in the corpus.

Every window (LENGTH bytes at a place) has one anchor: of the K-byte strings inside it, the one with the least hash,
the first on ties. Equal windows have equal anchors at equal places, so each window needs comparing only with windows of
the same anchor, and a window is met under its anchor alone.

1. A task finds the anchors of its texts (about one in 35 bytes). An anchor's fragment is all the bytes that its windows
   span; its hash goes along with that of the anchor, 128 bits together. Fragments equal to an earlier one repeat it
   window by window: a task settles those among its own texts, in blocks, and sends of each different one the earliest.
2. Sorted by anchor, equal fragments of all tasks are settled. What is left are the anchors with several different
   fragments, one of each; only their bytes are taken from the documents. Anchors with over SALT fragments are dealt over
   shards; anchors that a sample shows with very many are dealt over cells for the sorting too.
3. A shard builds a suffix array of its fragments: Larsson-Sadakane refinement in numpy (ranks by the first 8 bytes,
   doubled, only among suffixes that are still equal), and common prefixes by Kasai's method, stepped for all fragments
   side by side. In a run of suffixes with LENGTH bytes in common, all but the earliest (document, start) are repeats.
4. Dealt anchors: windows left over from each shard merge across shards by binary search in sorted 128-bit digests of
   the windows; again all but the earliest are repeats.
5. Spans of repeats go back to their documents.

Exact copies of a text never ship fragments: the copy with the least id stands for them, the others of LENGTH bytes or
more are repeats from end to end.

Defined results: a null text has no bytes. Texts shorter than LENGTH keep all. Documents that repeat an id and text are
one document, given back as often; an id with different texts names a document for each, in the order of their digests
and between the ids before and after. Rows without an id are left whole and are nobody's earlier copy. Empty tables give no rows. Other columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from .common import in_arrow, mix64, partitions, pressed, runs, utf8

LENGTH, K, SALT, SHARD_BYTES = 100, 32, 4096, 1 << 19
#: Text that a task settles at once; bytes of the sample that finds hot anchors; how many different fragments make an
#: anchor hot there (or what share of the sampled texts), and over how many cells its fragments are dealt.
BLOCK_BYTES, SAMPLE_BYTES, HOT, HOT_SHARE, HOT_CELLS = 6 << 20, 32 << 20, 64, 500, 64
_B, _C = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_ALL = 2**64 - 1
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
#: A longer text is hashed in segments.
SEGMENT = 1 << 20


def rolling(data: np.ndarray, k: int, base: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on, by doubling."""
    h, size, have = _BYTE[data], 1, {}
    have[1] = (h, base)
    while size * 2 <= k:
        h = h[:-size] * np.uint64(base) + h[size:]
        size, base = size * 2, base * base & _ALL
        if size & k:
            have[size] = (h, base)
    if size == k:
        return mix64(h)
    for s in sorted(have, reverse=True):
        if s < size and k - size >= s:
            more, b = have[s]
            m = len(h) - s
            h = h[:m] * np.uint64(b) + more[size : size + m]
            size += s
    return mix64(h)


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and their inverses, as far as a segment goes."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SEGMENT, x, np.uint64))]) for x in (_C, pow(_C, -1, 2**64)))


def _digests(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of data from `first` to `end`, by sums up to each place."""
    power, inverse = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)])])
    return mix64((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64) * np.uint64(_B))


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, hash of its fragment, first window, last window). bounds: where documents begin in data, and its end.

    A longer text is met in segments that share length - 1 bytes: the windows of an anchor at their edge come in two runs."""
    if len(data) > SEGMENT:
        parts = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for at in range(a, b, SEGMENT // 2):
                end = min(b, at + SEGMENT // 2 + length - 1)
                *hashes, first, last = anchors(data[at:end], np.array([0, end - at]), length, k)
                parts.append((*hashes, first + at, last + at))
        return tuple(np.concatenate(x) for x in zip(*parts))
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    h = rolling(data, k, _B)
    place = np.arange(len(h), dtype=np.uint64)
    key = (h >> np.uint64(24)) << np.uint64(24) | place  # of 16 MB at most
    width, low, reach = length - k + 1, key, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    whole = np.zeros(len(at), bool)  # windows that end in their document
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= length:
            whole[a : b - length + 1] = True
    starts = np.nonzero(whole)[0]
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    of = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(starts)) - 1
    first, last, of = starts[first], starts[last], of[first]
    return h[of], _digests(data, first, last + length), first, last


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, bounds) of stretches of rows of a batch; a binary column holds packed texts."""
    data, starts, ends = utf8(batch.column(column))
    packed = pa.types.is_binary(batch.column(column).type)
    for i, j in runs(starts, ends, 1 << 18 if packed else 1 << 19):
        parts = [data[a:b].tobytes() for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist())]
        parts = list(map(zstandard.ZstdDecompressor().decompress, parts)) if packed else parts
        yield i, j, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def suffix_array(data: np.ndarray, ends: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of data sorted by the bytes from there to the end of their fragment (ends), as far as `depth` bytes."""
    n = len(data)
    left = np.minimum(ends - np.arange(n), 8)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))
    key = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    cut = (8 * (8 - left)).astype(np.uint64)
    key = np.where(left == 8, key, (key >> cut) << cut)
    order = np.argsort(key)
    sorted_key, sorted_left = key[order], left[order]
    if ((sorted_key[1:] == sorted_key[:-1]) & (sorted_left[1:] != sorted_left[:-1])).any():
        # bytes 0 look like an end: of suffixes with equal bytes, one that ends sooner is less
        fix = np.lexsort((sorted_left, sorted_key))
        order, sorted_key, sorted_left = order[fix], sorted_key[fix], sorted_left[fix]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (sorted_left[1:] != sorted_left[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = start, -1
    h = 8
    while h < depth:
        single = new & np.append(new[1:], True)
        at = np.nonzero(~single)[0]  # places of the array still in groups of equal ranks
        if not len(at):
            break
        of = order[at]
        nxt = of + h
        inside = nxt < ends[of]
        second = np.where(inside, rank[np.minimum(nxt, n)], -1)
        by = (start[at].astype(np.uint64) << np.uint64(32)) | (second + 1).astype(np.uint64)
        turn = np.argsort(by)
        order[at], by = of[turn], by[turn]
        fresh = np.ones(len(at), bool)
        fresh[1:] = by[1:] != by[:-1]
        new[at] = fresh
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[at]] = start[at]
        h *= 2
    return order


def kasai(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, order: np.ndarray, depth: int = LENGTH, steps: np.ndarray | None = None) -> np.ndarray:
    """Common prefix, `depth` at most, of each suffix in the array with the one before it. begins, ends: of fragments.

    In text order a suffix shares at least one byte less than the suffix a byte before it; all fragments step together,
    eight bytes at a look. steps: how many suffixes of each fragment are asked for (others are given 0)."""
    n, rank = len(data), np.empty(len(data), np.int64)
    rank[order] = np.arange(n)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    sizes = ends - begins
    steps = sizes if steps is None else steps
    turn = np.argsort(-steps, kind="stable")
    begin, end, shared = begins[turn], ends[turn], np.zeros(len(begins), np.int64)
    end_of = np.repeat(ends, sizes)
    words = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(16, np.uint8)]), (n + 8, 8), (1, 1))
    words = np.ascontiguousarray(words).view("<u8").ravel()
    live, out = np.searchsorted(-steps[turn], -np.arange(int(steps.max())), side="left"), np.zeros(n, np.int64)
    rank_of, old = np.append(rank, n), np.full(len(begins), -1)
    for t, m in enumerate(live.tolist()):
        i = begin[:m] + t
        j = before[i]
        # the array leaves suffixes equal to `depth` in any order, so the neighbour a byte on may stand on the other side
        below = (old[:m] >= 0) & (rank_of[old[:m] + 1] < rank[i])
        h = np.where(below, np.maximum(shared[:m] - 1, 0), 0)
        most = np.minimum(np.minimum(end[:m] - i, np.where(j >= 0, end_of[j] - j, 0)), depth)
        h = np.minimum(h, most)
        go = np.nonzero(h < most)[0]
        while len(go):
            x = words[i[go] + h[go]] ^ words[j[go] + h[go]]
            equal = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3  # bytes before the first that differs
            h[go] = np.minimum(h[go] + equal, most[go])
            go = go[(equal == 8) & (h[go] < most[go])]
        shared[:m], old[:m] = h, j
        out[rank[i]] = h
    return out


FRAGMENT = "anchor long, salt int, dealt boolean, doc {id}, start long, windows int, bytes binary"
CANDIDATE = "anchor long, print long, doc {id}, start int, windows int"


def _numbers(ids: pa.Array) -> np.ndarray:
    """Numbers that order the ids."""
    return ids.to_numpy() if pa.types.is_integer(ids.type) else np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]


def _merged(row: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of one of its members, first, windows) of runs of neighbouring windows of the same row."""
    if not len(row):
        return row, first, count
    turn = np.lexsort((first, row))
    row, first, count = row[turn], first[turn].astype(np.int64), count[turn]
    near = np.cumsum(np.append(0, row[1:] != row[:-1])) << 32
    ends = np.maximum.accumulate(near + first + count)
    new = np.append(True, near[1:] + first[1:] > ends[:-1])
    begin = np.nonzero(new)[0]
    last = np.append(begin[1:], len(row)) - 1
    return turn[begin], first[begin], (ends[last] - near[last] - first[begin]).astype(np.int32)


class _Block:
    """Anchors of some texts of a task. Equal fragments but the earliest (document, start) are settled there and then, as
    runs with a negative number of windows; of a fragment that all documents hold, a block sends one."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, ids: pa.Array, h: np.ndarray, g: np.ndarray, first: np.ndarray, windows: np.ndarray, size: int) -> None:
        self.parts.append((ids, h, g, first.astype(np.int32), windows.astype(np.int32)))
        self.size += size

    def done(self) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([p[0] for p in self.parts])
        h, g, first, windows = (np.concatenate([p[k] for p in self.parts]) for k in range(1, 5))
        self.parts, self.size = [], 0
        turn = np.lexsort((first, _numbers(ids), g, h))
        again = np.append(False, (h[turn[1:]] == h[turn[:-1]]) & (g[turn[1:]] == g[turn[:-1]]))[: len(turn)]
        late, turn = turn[again], turn[~again]
        of, run, count = _merged(_numbers(ids)[late], first[late], windows[late])
        take = np.concatenate([turn, late[of]])
        columns = [h[take], g[take], np.concatenate([first[turn], run.astype(np.int32)]), np.concatenate([windows[turn], -count])]
        columns[0][len(turn) :] += mix64(run.astype(np.uint64))  # settled runs go anywhere
        for s in range(0, len(take), 50_000):
            h_, g_, start, n = (x[s : s + 50_000] for x in columns)
            yield pa.RecordBatch.from_arrays([pa.array(h_.view(np.int64)), pa.array(g_.view(np.int64)), ids.take(pa.array(take[s : s + 50_000])), pa.array(start), pa.array(n)], ["anchor", "print", "doc", "start", "windows"])


class _Settler:
    """Takes rows sorted by (anchor, print, doc, start) and gives (doc, start, windows, anchor, cell). Fragments equal to an
    earlier one, and settled runs, have a null anchor; of an anchor with several different fragments one of each goes on,
    and of one with over `salt` in cells. A group's fragments are held back until there are so many, so memory is bounded."""

    def __init__(self, hot: np.ndarray, salt: int):
        self.hot, self.salt, self.held, self.last, self.sent = hot, salt, None, None, 0  # of the open anchor: (anchor, print), fragments sent

    def __call__(self, table: pa.Table, end: bool) -> pa.RecordBatch:
        h, g, start, windows = (table.column(c).to_numpy() for c in (0, 1, 3, 4))
        ids = table.column(2).combine_chunks()
        run = windows < 0
        gone, live = np.nonzero(run)[0], np.nonzero(~run)[0]
        h_, g_ = h[live], g[live]
        new_h = np.append(True, h_[1:] != h_[:-1])[: len(live)]
        new = new_h | np.append(True, g_[1:] != g_[:-1])[: len(live)]
        if len(live) and self.last and self.last[0] == h_[0]:
            new[0] = self.last[1] != g_[0]
        elif len(live):
            self.last, self.sent = None, 0
        gone, of, group = np.concatenate([gone, live[~new]]), live[new], (np.cumsum(new_h) - 1)[new]
        n = np.bincount(group, minlength=int(new_h.sum())) if len(live) else np.zeros(0, np.int64)
        k = np.arange(len(group)) - (np.cumsum(n) - n)[group]
        if len(n):
            n[0] += self.sent
            k[group == 0] += self.sent
        warm = np.isin(h[of], self.hot)
        dealt, keep = (n[group] > self.salt) | warm, (n[group] > 1) | warm
        back = np.zeros(len(of), bool)  # the open group, as long as it isn't known to be dealt
        if len(n) and not end:
            if n[-1] > self.salt or (self.sent and len(n) == 1):
                self.last, self.sent = (h_[-1], g_[-1]), int(n[-1])
                dealt[group == len(n) - 1] = True
            else:
                back, self.last, self.sent = group == len(n) - 1, None, 0
        self.held = table.take(pa.array(of[back]))
        spread = np.where(warm, ((g[of] & (HOT_CELLS - 1)) << 20), 0) + k // self.salt
        keep &= ~back
        of, cell = of[keep], np.where(dealt, spread, -1)[keep]
        take = np.concatenate([gone, of])
        anchor = pa.concat_arrays([pa.nulls(len(gone), pa.int64()), pa.array(h[of])])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(take)), pa.array(start[take]), pa.array(np.abs(windows[take])), anchor, pa.array(np.concatenate([np.full(len(gone), -1), cell]).astype(np.int32))], ["doc", "start", "windows", "anchor", "cell"])


def _settle(batches: Iterator[pa.RecordBatch], hot: np.ndarray, salt: int = SALT, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    own, parts, size = _Settler(hot, salt), [], 0
    for batch in batches:
        parts.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= rows:
            yield own(pa.concat_tables(parts), False)
            parts, size = [own.held], 0
    if parts:
        yield own(pa.concat_tables(parts), True)


def _repeats(dealt: np.ndarray, doc: np.ndarray, start: np.ndarray, raw: list[bytes], length: int):
    """Of a shard's fragments: (fragment, offset) of repeated windows, the same of windows that dealt anchors leave over,
    and the bytes with the fragments' places in them. doc: numbers that order the documents."""
    sizes = np.array([len(b) for b in raw])
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes)
    begins, end_of = ends - sizes, np.repeat(ends, sizes)
    order = suffix_array(data, end_of, length)
    group = np.cumsum(kasai(data, begins, ends, order, length, sizes - length + 1) < length)
    at = np.nonzero(end_of[order] - order >= length)[0]
    fragment = np.repeat(np.arange(len(raw)), sizes)[order[at]]
    offset, group = order[at] - begins[fragment], group[at]
    turn = np.lexsort((start[fragment] + offset, doc[fragment], group))
    fragment, offset, group = fragment[turn], offset[turn], group[turn]
    earliest = np.ones(len(group), bool)
    earliest[1:] = group[1:] != group[:-1]
    left = earliest & dealt[fragment]
    return fragment[~earliest], offset[~earliest], fragment[left], offset[left], data, begins


def _as_runs(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, last) of runs of neighbouring places."""
    turn = np.lexsort((place, doc))
    doc, place = doc[turn], place[turn]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], place[first], place[last]


def _shards(batches: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[pa.Table]:
    """Sorted rows in tables of about SHARD_BYTES that don't divide rows of equal keys."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            if held and size >= SHARD_BYTES:
                same = np.ones(batch.num_rows, bool)
                for k, c in enumerate(columns):
                    same &= c == held[-1].column(k)[-1].as_py()
                m = batch.num_rows if same.all() else int(np.argmin(same))
                if m:
                    held.append(batch.slice(0, m))
                    batch = batch.slice(m)
                if batch.num_rows:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                continue
            sizes = np.cumsum(_sizes(batch.column(batch.num_columns - 1)))
            m = min(batch.num_rows, int(np.searchsorted(sizes, SHARD_BYTES - size)) + 1)
            held.append(batch.slice(0, m))
            size += int(sizes[m - 1])
            batch = batch.slice(m)
    if held:
        yield pa.Table.from_batches(held)


def _sizes(column: pa.Array) -> np.ndarray:
    _, starts, ends = utf8(column)
    return ends - starts


def _hot(own: DataFrame, length: int, k: int) -> np.ndarray:
    """Hashes of anchors with very many different fragments, seen in a sample of bounded size. It spreads work, and no more."""
    n = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, SAMPLE_BYTES / max(1, n))
    some = own.where(F.xxhash64("doc", F.lit(5)).cast("double") / 2.0**64 + 0.5 < share)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in _texts(batch, 1):
                h, g, *_ = anchors(data, bounds, length, k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], ["h", "g"])

    least = F.greatest(F.lit(HOT), F.lit(some.count() // HOT_SHARE))
    counts = some.transform(in_arrow, find, "h long, g long").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.array([r.h for r in counts.select("h").collect()], np.int64)


def repeated_spans(own: DataFrame, stand: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """own: (doc, text), each doc once; stand: (doc) of the texts that stand for their copies.
    (doc, spans: array of (first, last) windows that repeat an earlier one)."""
    spark, n = own.sparkSession, partitions(own.sparkSession)
    kind, packed = own.schema["doc"].dataType.simpleString(), _packed(own).join(stand.hint("shuffle_hash"), "doc", "left_semi")
    hot, salt = _hot(own, length, k), SALT

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for i, _, data, bounds in _texts(batch, 1):
                h, g, first, last = anchors(data, bounds, length, k)
                row = np.searchsorted(bounds, first, side="right") - 1
                block.add(batch.column(0).take(pa.array(row + i)), h, g, first - bounds[row], last - first + 1, len(data))
                if block.size >= BLOCK_BYTES:
                    yield from block.done()
        if block.parts:
            yield from block.done()

    place = F.when(F.col("anchor").isin(hot.tolist()), F.xxhash64("anchor", F.pmod("print", F.lit(HOT_CELLS)))).otherwise(F.col("anchor")) if len(hot) else F.col("anchor")
    candidates = packed.transform(in_arrow, find, CANDIDATE.format(id=kind)).repartition(n, place).sortWithinPartitions("anchor", "print", "doc", "start")
    held = candidates.transform(in_arrow, lambda batches: _settle(batches, hot, salt), f"doc {kind}, start int, windows int, anchor long, cell int").groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "anchor", "cell")).alias("held"))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "salt", "dealt", "doc", "start", "windows", "bytes"]
        for batch in batches:
            ids, lists, marks = batch.column(0), batch.column(2), batch.column(3).to_numpy()
            at = lists.offsets.to_numpy().astype(np.int64)
            at, flat = at - at[0], lists.flatten()
            start, windows, cell = (flat.field(c).to_numpy() for c in (0, 1, 3))
            fresh = flat.field(2).is_valid().to_numpy(zero_copy_only=False)
            anchor = flat.field(2).fill_null(0).to_numpy()
            owner = np.repeat(np.arange(len(ids)), np.diff(at))
            of, first, count = _merged(owner[~fresh], start[~fresh], windows[~fresh])
            row = owner[~fresh][of]
            m = len(row)
            yield pa.RecordBatch.from_arrays([pa.array(marks[row] + first), pa.array(np.zeros(m, np.int32)), pa.array(np.zeros(m, bool)), ids.take(pa.array(row)), pa.array(first.astype(np.int64)), pa.array(count.astype(np.int32)), pa.array([b""] * m, pa.binary())], names)
            for i, j, data, bounds in _texts(batch, 1):
                here = np.nonzero(fresh[at[i] : at[j]])[0] + at[i]
                text, row = data.tobytes(), owner[here]
                begin = bounds[row - i] + start[here]
                raw = [text[a:b] for a, b in zip(begin.tolist(), (begin + windows[here] + length - 1).tolist())]
                for s in range(0, len(raw), 20_000):
                    o = slice(s, s + 20_000)
                    x, c = here[o], cell[here[o]]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[x]), pa.array(np.maximum(c, 0).astype(np.int32)), pa.array(c >= 0), ids.take(pa.array(row[o])), pa.array(start[x].astype(np.int64)), pa.array(windows[x]), pa.array(raw[o], pa.binary())], names)

    fragments = packed.join(held.hint("shuffle_hash"), "doc").select("doc", "z", "held", F.xxhash64("doc").alias("mark")).transform(in_arrow, ship, FRAGMENT.format(id=kind))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "first", "last", "x", "y"]
        for part in _shards(batches):
            part = part.combine_chunks()
            full = _sizes(part["bytes"]) > 0
            settled = part.filter(pa.array(~full))
            first = settled["start"].to_numpy()
            none = lambda m: pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([settled["doc"].combine_chunks(), pa.array(first), pa.array(first + settled["windows"].to_numpy() - 1), none(len(first)), none(len(first))], names)
            part = part.filter(pa.array(full))
            if not part.num_rows:
                continue
            ids, start = part["doc"].combine_chunks(), part["start"].to_numpy()
            known, doc = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
            known = pa.array(known, ids.type)
            f, o, lf, lo, data, begins = _repeats(part["dealt"].to_numpy(), doc, start, part["bytes"].to_pylist(), length)
            d, a, b = _as_runs(doc[f], start[f] + o)
            yield pa.RecordBatch.from_arrays([known.take(pa.array(d)), pa.array(a), pa.array(b), none(len(d)), none(len(d))], names)
            if len(lf):
                x, y = rolling(data, length, _B), rolling(data, length, _B ^ 0x5555_0000_5555_0000)
                for s in range(0, len(lf), 50_000):
                    ff, oo = lf[s : s + 50_000], lo[s : s + 50_000]
                    at, w = pa.array(start[ff] + oo), begins[ff] + oo
                    yield pa.RecordBatch.from_arrays([known.take(pa.array(doc[ff])), at, at, pa.array(x[w].view(np.int64)), pa.array(y[w].view(np.int64))], names)

    met = fragments.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt").transform(in_arrow, sort, f"doc {kind}, first long, last long, x long, y long")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            done = batch.column(3).null_count  # nulls stand first: spans that are settled
            yield pa.RecordBatch.from_arrays(batch.slice(0, done).columns[:3], ["doc", "first", "last"])
            rest = batch.slice(done)
            if not rest.num_rows:
                continue
            x, y = (rest.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
            # where a window's digest begins in the sorted rows, by binary search; the row there is the earliest window
            pairs = np.zeros(len(x), [("x", np.int64), ("y", np.int64)])
            pairs["x"], pairs["y"] = x, y
            begin = np.searchsorted(pairs, pairs)
            again = begin < np.arange(len(x))
            again[begin == 0] |= before == (x[0], y[0])
            before = (x[-1], y[-1])
            rest = rest.filter(pa.array(again))
            yield pa.RecordBatch.from_arrays(rest.columns[:3], ["doc", "first", "last"])

    spread = met.repartition(n, F.coalesce("x", F.xxhash64("doc", "first"))).sortWithinPartitions(F.asc_nulls_first("x"), "y", "doc", "first")
    return spread.transform(in_arrow, merge, f"doc {kind}, first long, last long").groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _packed(own: DataFrame) -> DataFrame:
    """(doc, z): compressed texts, for the one exchange that all joins read."""
    return pressed(own).withColumnRenamed("text", "z")


def _kept(first: np.ndarray, last: np.ndarray, size: int, length: int) -> tuple[list[tuple[int, int]], int, int]:
    """(stretches of bytes that stay, bytes removed, maximal runs removed) of a text with these repeated windows."""
    turn = np.argsort(first, kind="stable")
    a, b = first[turn], np.maximum.accumulate(last[turn] + length)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    begins, ends = a[new], b[np.append(np.nonzero(new)[0][1:], len(a)) - 1]
    edges = [0, *(x for pair in zip(begins.tolist(), ends.tolist()) for x in pair), size]
    return list(zip(edges[::2], edges[1::2])), int((ends - begins).sum()), len(begins)


def _spliced(packed: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """(doc, n_removed, n_spans, kept_sha256): of each text that stands for its copies and repeats something."""
    kind = packed.schema["doc"].dataType.simpleString()

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy().astype(np.int64)
            at, flat = at - at[0], lists.flatten()
            first, last = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for i, j, data, bounds in _texts(batch, 1):
                rows, whole = [], memoryview(data)
                for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), i):
                    parts, removed, spans = _kept(first[at[r] : at[r + 1]], last[at[r] : at[r + 1]], b - a, length)
                    digest = hashlib.sha256()
                    for x, y in parts:
                        digest.update(whole[a + x : a + y])
                    rows.append((removed, spans, digest.hexdigest()))
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], ["doc", "n_removed", "n_spans", "kept_sha256"])

    return packed.join(spans.hint("shuffle_hash"), "doc").select("doc", "z", "spans").transform(in_arrow, splice, f"doc {kind}, n_removed long, n_spans long, kept_sha256 string")


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column | None, bool]:
    """(what names a row's document if some id has different texts: the id with a digest of the text; None if the id does,
    does an id occur twice)."""
    ident, digest = F.col(id_col), F.xxhash64(text_col)
    by_id = docs.where(ident.isNotNull()).groupBy(ident).agg((F.min(digest) != F.max(digest)).alias("differ"), (F.count("*") > 1).alias("again"))
    found = by_id.agg(F.max("differ").alias("differ"), F.max("again").alias("again")).first()
    if not found.differ:
        return None, bool(found.again)
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)  # as strings of equal length they keep their order
    ordered = F.lpad((ident.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0") if whole else ident.cast("string")
    return F.concat(ordered, F.lit("\0"), F.md5(F.coalesce(text_col, F.lit("")))), True


def _parts(docs: DataFrame, id_col: str, text_col: str, length: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """(rows: (id, doc, n_bytes, sha, copy), packed texts, spans of texts that stand for their copies, what names a row)."""
    name, again = _named(docs, id_col, text_col)
    name = F.col(id_col) if name is None else name
    named = docs.select(F.col(id_col).alias("id"), name.alias("doc"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = named.select("id", "doc", size.alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    least = rows.where("doc is not null").groupBy("sha").agg(F.min("doc").alias("stands"))
    own = named.select("doc", "text").where(f"doc is not null and octet_length(text) >= {length}")
    own = own.dropDuplicates(["doc"]) if again else own
    copy = F.coalesce((F.col("n_bytes") >= length) & (F.col("doc") > F.col("stands")), F.lit(False))
    return rows.join(least, "sha", "left").withColumn("copy", copy), _packed(own), repeated_spans(own, least.select(F.col("stands").alias("doc")), length, k), name


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """docs' rows as (doc, n_bytes, n_removed, n_spans, kept_sha256); the digest is of the bytes that stay."""
    rows, packed, spans, _ = _parts(docs, id_col, text_col, length, k)
    none, copy = hashlib.sha256(b"").hexdigest(), F.col("copy")
    return rows.join(_spliced(packed, spans, length), "doc", "left").select(
        F.col("id").alias("doc"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(copy, F.lit(none)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = LENGTH, k: int = K) -> DataFrame:
    """docs with texts cut by their repeated spans (and chars_col, where there is one, counted again). No row goes.

    A character that loses some of its bytes goes with all of them. Texts move compressed, once to be sorted and once to be cut."""
    rows, _, spans, name = _parts(docs, id_col, text_col, length, k)
    at, columns = docs.columns.index(text_col), docs.columns
    marks = rows.where("copy").select(F.col("doc").alias("__doc"), F.lit(None).cast(spans.schema["spans"].dataType).alias("__spans"), F.lit(True).alias("__copy")).distinct()
    marks = marks.unionByName(spans.select(F.col("doc").alias("__doc"), F.col("spans").alias("__spans"), F.lit(False).alias("__copy")))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts, chars = [], []
            for z, spans, copy in zip(batch.column(at), batch.column(len(columns)), batch.column(len(columns) + 1).to_pylist()):
                text = None if not z.is_valid else b"" if copy else open_(z.as_buffer())
                kept = text
                if spans.is_valid:
                    found = spans.values
                    parts, *_ = _kept(found.field(0).to_numpy(), found.field(1).to_numpy(), len(text), length)
                    kept = b"".join([text[a:b] for a, b in parts])
                texts.append(None if kept is None else kept.decode("utf-8", "ignore"))
                chars.append(len(texts[-1]) if copy or spans.is_valid else None)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == at else c for n, c in enumerate(batch.columns[: len(columns)])] + [pa.array(chars, pa.int64())], [*columns, "__chars"])

    schema = StructType(list(docs.schema))
    both = pressed(docs.withColumn("__doc", name), text_col).join(marks.hint("shuffle_hash"), "__doc", "left").select(*columns, "__spans", "__copy")
    cut = both.transform(in_arrow, unpack, schema.add("__chars", "long"))
    if chars_col in columns:
        cut = cut.withColumn(chars_col, F.coalesce(F.col("__chars").cast(docs.schema[chars_col].dataType), chars_col))
    return cut.select(columns)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).withColumnRenamed("doc", "doc_id")
