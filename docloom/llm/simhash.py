"""SimHash near-duplicates by vantage-point trees.

A document's fingerprint is the bitwise majority of the hashes of its word shingles. Equal fingerprints are first
aggregated to one (with partial sums, so a copy held by a third of all rows costs one row a task). Distinct fingerprints
at most `radius` bits apart are then found exactly:

* The bits (64, or more lanes of 64) are cut into `radius // 2 + 1` bands; two fingerprints within `radius` differ by 1 bit at most in one of
  them. Each band has a vantage-point tree over its values, so that trees search with radius 1 and prune well where a
  tree over all 64 bits with radius 4 would visit nearly every branch.
* A tree is built on a bounded sample and broadcast. At each vantage point, a value nearer than the threshold goes
  inside, the rest outside; every fingerprint has one home leaf, the shard that stores it. As a query it also visits the
  leaves that the triangle bound can't rule out. A pair is met from its inner member alone: a home branch sends visitors
  to the outer side only, within 1 of the threshold.
* In a shard, fingerprints are compared in numpy by 64-bit distance, after further vantage-point splits. A shard whose
  share of the sample promises more than HOT fingerprints is dealt over cells: stored once, queried in all its cells.
* A task gives back a spanning forest of its links, not all pairs; components follow by large-star and small-star steps.

The pipeline's near copies (`near_copies`) take those links, of a wider radius, as candidates alone: what chains of
candidates connect is a family, and within a family two texts are linked if the Jaccard similarity of their sets of
shingles, counted exactly, is at least SIMILAR. Families are cut into blocks of bounded size and each pair of blocks is
a task's group, so no family is too large for a task, but each member of one of B blocks is sent to B groups.

Defined results: a null or blank text has no shingle and fingerprint zero, and links like any other. A text of fewer
words than a shingle is one shingle. Null ids don't count for the smallest id (a group of null ids alone has none).
Repeated rows are equal fingerprints. Empty tables give no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, checkpointed, in_arrow, mix64, partitions, pressed, runs, utf8
from .components import components

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints that each tree is built on; a leaf is split until it would hold about LEAF of all; depth at most DEPTH.
SAMPLE, LEAF, DEPTH, HOT = 8192, 1024, 12, 16384
#: Near copies: the least Jaccard similarity as a fraction; members and bytes of text in one block of a family, about.
SIMILAR, BLOCK, BLOCK_BYTES = (4, 5), 1024, 8 << 20


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64) if words else np.zeros(0, np.uint64)
    text = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends[: -width]]]
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(words) - width + 1)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the highest."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_280):
        bits = np.unpackbits(hashes[i : i + 65_280].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        total += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes, width: int = WORDS, lanes: int = 1) -> tuple[int, ...]:
    """The fingerprint in lanes of 64 bits: the first of the hashes themselves, more of a further mix of them."""
    hashes, out = _hashes(text.lower().split(), width), []
    for lane in range(lanes):
        of = mix64(hashes + np.uint64(lane)) if lane else hashes
        out.append(int.from_bytes(np.packbits(_ones(of) * 2 > len(of)).tobytes(), "big") if len(of) else 0)
    return tuple(out)


def _names(lanes: int) -> list[str]:
    return [f"fp{k}" for k in range(lanes)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, lanes: int = 1) -> DataFrame:
    """(id, fp0, ...): the lanes of the fingerprint as signed longs."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = utf8(batch.column(1))
            for i, j in runs(starts, ends):
                fps = np.array([fingerprint(data[a:b].tobytes(), width, lanes) for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_arrow(fps)], ["id", *_names(lanes)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(in_arrow, of, f"id {kind}, {_schema(_names(lanes))}")


def _schema(names: list[str]) -> str:
    return ", ".join(f"{x} long" for x in names)


def _arrow(fps: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(fps.shape[1])]


def _numpy(columns: list[pa.Array]) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1).view(np.uint64)


def bands(radius: int, lanes: int = 1) -> list[list[tuple[int, int, int]]]:
    """Of each band its (lane, shift, bits): radius // 2 + 1 bands, of which one differs by 1 bit at most."""
    n, bits = radius // 2 + 1, 64 * lanes
    cuts = [bits * k // n for k in range(n + 1)]
    return [[(lane, max(a - 64 * lane, 0), min(b, 64 * lane + 64) - max(a, 64 * lane)) for lane in range(a // 64, (b - 1) // 64 + 1)] for a, b in zip(cuts, cuts[1:])]


def band_values(fps: np.ndarray, band: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for lane, shift, bits in band:
        out = out << np.uint64(bits) | (fps[:, lane] >> np.uint64(shift)) & np.uint64(2**bits - 1)
    return out


def grow(values: np.ndarray, leaf: float, depth: int = DEPTH) -> dict:
    """A tree over a sample: per node the vantage point, the threshold and the children; a negative child -k - 1 is leaf k.

    share: each leaf's part of the sample."""
    tree: dict = {"at": [], "mu": [], "child": [], "share": []}

    def node(part: np.ndarray, left: int) -> int:
        if len(part) > leaf and left:
            middle = part[len(part) // 2]
            far = part[np.argmax(np.bitwise_count(part ^ middle))]  # a point at the rim sees distances spread wider
            d = np.bitwise_count(part ^ far)
            mu = int(np.sort(d)[(len(d) - 1) // 2])
            for mu in (mu, mu - 1):
                inside = d <= mu
                if 0 < inside.sum() < len(part):
                    k = len(tree["at"])
                    tree["at"].append(far), tree["mu"].append(mu), tree["child"].append([0, 0])
                    tree["child"][k] = [node(part[inside], left - 1), node(part[~inside], left - 1)]
                    return k
        tree["share"].append(len(part) / max(1, len(values)))
        return -len(tree["share"])

    tree["root"] = node(values, depth)
    return tree


def route(tree: dict, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, indices, are they at home): every home once, and the leaves that a query must visit besides."""
    stack = [(tree["root"], np.arange(len(values)), True)]
    while stack:
        k, of, home = stack.pop()
        if not len(of):
            continue
        if k < 0:
            yield -k - 1, of, home
            continue
        d, mu = np.bitwise_count(values[of] ^ tree["at"][k]).astype(np.int16), tree["mu"][k]
        inner, outer = tree["child"][k]
        if home:
            inside = d <= mu
            stack += [(inner, of[inside], True), (outer, of[~inside], True), (outer, of[inside & (d > mu - 1)], False)]
        else:
            stack += [(inner, of[d <= mu + 1], False), (outer, of[d > mu - 1], False)]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances in bits of fingerprints, lane by lane."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0])
    for k in range(1, a.shape[-1]):
        out = out + np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def _links(homes: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query index, home index) within the radius. Splits by vantage points while both sides are large."""
    stack = [(np.arange(len(queries)), np.arange(len(homes)), 6)]
    while stack:
        q, h, left = stack.pop()
        if len(q) and len(h) > 2048 and left:
            at = homes[h[len(h) // 2]]
            dh, dq = _apart(homes[h], at).astype(np.int16), _apart(queries[q], at).astype(np.int16)
            mu = np.sort(dh)[len(dh) // 2]
            if (dh > mu).any():
                stack += [(q[dq <= mu + radius], h[dh <= mu], left - 1), (q[dq > mu - radius], h[dh > mu], left - 1)]
                continue
        stored, step = homes[h], max(1, 200_000 // max(1, len(h)))
        for i in range(0, len(q), step):
            a, b = np.nonzero(_apart(queries[q[i : i + step], None], stored) <= radius)
            if len(a):
                yield q[i + a], h[b]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; parent leads to each set's least member in one step."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def _forest(homes: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of queries to homes, and of homes to each other: (member, least member)."""
    all_q = np.concatenate([homes, queries])
    nodes, at_q = np.unique(all_q, axis=0, return_inverse=True) if all_q.shape[1] > 1 else _unique(all_q)
    parent, at_h = np.arange(len(nodes)), at_q[: len(homes)]
    for a, b in _links(homes, all_q, radius):
        _union(parent, at_q[a], at_h[b])
    moved = np.nonzero(parent != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[parent[moved]]


def _unique(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(fps[:, 0], return_inverse=True)
    return values[:, None], at


def links(distinct: DataFrame, radius: int = RADIUS, reach: int = 0) -> DataFrame:
    """distinct: (fp0, ...). (u0, ..., v0, ...): links that connect what chains of at most `radius` bits connect.

    With a `reach` over the radius, pairs that are up to `reach` bits apart and meet in a band link too."""
    spark, names = distinct.sparkSession, [c for c in distinct.columns if c.startswith("fp")]
    lanes, cut, n = len(names), bands(radius, len(names)), distinct.count()
    few = distinct.select(names).orderBy(F.xxhash64(*names)).limit(min(SAMPLE, max(1, n // 4))).collect()
    sample = np.array(few, np.int64).reshape(-1, lanes).view(np.uint64)
    trees = spark.sparkContext.broadcast([grow(np.sort(band_values(sample, b)), LEAF * len(sample) / max(1, n)) for b in cut])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _numpy(batch.columns)
            for k, (band, tree) in enumerate(zip(cut, trees.value)):
                for leaf, of, home in route(tree, band_values(fps, band)):
                    cells, x = max(1, round(tree["share"][leaf] * n / HOT)), fps[of]
                    own = (mix64(x[:, 0]) % np.uint64(cells)).astype(np.int32)
                    for c in range(cells):
                        at_home = (own == c) if home else np.zeros(len(x), bool)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k * (1 << 20) + leaf, np.int32)), pa.array(np.full(len(x), c, np.int32)), pa.array(at_home), *_arrow(x)], ["leaf", "cell", "home", *names])

    ends = [f"{side}{k}" for side in "uv" for k in range(lanes)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            home = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in parts])
            fps = np.concatenate([_numpy(p.columns[3:]) for p in parts])
            return _forest(fps[home], fps[~home], max(radius, reach))

        yield from _joined(by_group(batches, 2, done), ends)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _joined(((_numpy(b.columns[:lanes]), _numpy(b.columns[lanes:])) for b in batches), ends)

    shards = distinct.select(names).transform(in_arrow, deal, f"leaf int, cell int, home boolean, {_schema(names)}")
    met = shards.repartition(partitions(spark), "leaf", "cell").sortWithinPartitions("leaf", "cell").transform(in_arrow, meet, _schema(ends))
    # a family that many tasks met has a tree from each; where a member's links meet, they join those trees into one
    return met.repartition(partitions(spark), *ends[:lanes]).transform(in_arrow, again, _schema(ends)).distinct()


def _joined(pairs: Iterator[tuple[np.ndarray, np.ndarray]], ends: list[str], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """One forest (member, least member) for the links of several shards, or for `most` links at a time."""
    def forest() -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([u, v]), axis=0, return_inverse=True) if u.shape[1] > 1 else _unique(np.concatenate([u, v]))
        parent = np.arange(len(nodes))
        _union(parent, at[: len(u)], at[len(u) :])
        moved = np.nonzero(parent != np.arange(len(nodes)))[0]
        return pa.RecordBatch.from_arrays([*_arrow(nodes[moved]), *_arrow(nodes[parent[moved]])], ends)

    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size > most:
            yield forest()
            held, size = [], 0
    if held:
        yield forest()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, radius: int = RADIUS, lanes: int = 1) -> DataFrame:
    """(id, fp0, ..., component_id): one row for each row of docs; component_id is the smallest id that links reach."""
    names = _names(lanes)
    node = lambda side: F.col(f"{side}0") if lanes == 1 else F.struct(*[F.col(f"{side}{k}").alias(n) for k, n in enumerate(names)])
    prints = checkpointed(fingerprints(docs, id_col, text_col, width, lanes))
    distinct = checkpointed(prints.groupBy(*names).agg(F.min("id").alias("least")))
    roots = components(links(distinct, radius).select(node("u").alias("u"), node("v").alias("v"))).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = distinct.withColumn("node", node("fp")).join(roots, "node", "left").select(*names, F.coalesce("root", "node").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # distinct fingerprints on both sides but one: a root with very many members is split by AQE
    of = rooted.join(least, "root").select(*names, "component_id")
    return prints.join(of, names).select("id", *names, "component_id")


#: Near copies of a corpus: five words a shingle, 128 bits. Shingle sets of Jaccard similarity 0.8 (cosine 0.89) differ
#: in 128 * acos(0.89) / pi = 19 bits on average, give or take 4; unrelated texts in 64, give or take 6. Bands are those
#: of the radius, which they keep exactly; of pairs up to `reach` bits apart each band meets a fifth at least.
CORPUS = {"width": 5, "lanes": 2, "radius": 22, "reach": 32}


def shingles(text: bytes, width: int) -> np.ndarray:
    """The set of the text's shingles, as sorted hashes."""
    return np.unique(_hashes(text.lower().split(), width))


def set_print(hashes: np.ndarray, lanes: int) -> tuple[int, ...]:
    """A digest of the set and the lanes of its fingerprint. Of an even number of shingles the first breaks ties, as
    fingerprints of few shingles would have more zeros than ones else, and lie close without a shingle in common."""
    out = [xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)]
    for lane in range(lanes):
        of = mix64(hashes + np.uint64(lane)) if lane else hashes
        out.append(int.from_bytes(np.packbits(_ones(of) * 2 + _ones(of[:1]) > len(of)).tobytes(), "big") if len(of) else 0)
    return tuple(out)


def set_prints(docs: DataFrame, id_col: str, text_col: str, width: int, lanes: int) -> DataFrame:
    """(id, key, size, set, fp0, ...): digest and bytes of the text, digest and fingerprint of its set of shingles."""
    names = ["set", *_names(lanes)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = utf8(batch.column(3))
            for i, j in runs(starts, ends):
                found = np.array([set_print(shingles(data[a:b].tobytes(), width), lanes) for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), *_arrow(found)], ["id", "key", "size", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"), F.col(text_col).alias("text"))
    return rows.transform(in_arrow, of, f"id {kind}, key long, size long, {_schema(names)}")


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between sets of Jaccard similarity SIMILAR or more: (member, least member).

    A set is counted against all others by the places of its shingles. Sets of the largest component needn't be: a pair
    in different components has one outside it."""
    n, (num, den) = len(sets), SIMILAR
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner, last = np.repeat(np.arange(n), sizes)[order], np.cumsum(np.bincount(at))
    first = np.append(0, last[:-1])
    parent, todo = np.arange(n), np.ones(n, bool)
    while True:
        left = todo & (parent != np.bincount(parent).argmax()) if (~todo).any() else todo
        if not left.any():
            break
        i = int(left.argmax())
        todo[i] = False
        mine = at[ends[i] - sizes[i] : ends[i]]
        lengths = last[mine] - first[mine]
        places = np.repeat(first[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        both = np.bincount(owner[places], minlength=n)
        near = np.nonzero(both * (num + den) >= num * (sizes + sizes[i]))[0]
        _union(parent, np.full(len(near), i), near)
    moved = np.nonzero(parent != np.arange(n))[0]
    return moved, parent[moved]


def verified(members: DataFrame, width: int) -> DataFrame:
    """members: (family, blocks, set, text as `pressed` gives it). (u, v): links of sets that connect what chains of similar sets connect."""
    own = F.pmod(F.xxhash64("family", "set"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumns({"own": own, "other": others}).select("family", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "set", "text")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            own, ids = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in (3, 4))
            open_ = zstandard.ZstdDecompressor().decompress
            sets = [shingles(open_(t), width) for p in parts for t in p.column(5).to_pylist()]
            u, v = similar(sets)
            if own[0] != own[-1]:  # links within a block are given by its group with itself; here one from each component
                lone, root, cut = np.ones(len(ids), bool), np.arange(len(ids)), int(np.argmax(own != own[0]))
                root[u] = v
                lone[similar(sets[:cut])[0]] = False
                lone[similar(sets[cut:])[0] + cut] = False
                u = np.nonzero(lone & (root != np.arange(len(ids))))[0]
                v = root[u]
            return ids[u], ids[v]

        held: list = []
        for pair in by_group(batches, 3, done):
            held.append(pair)
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["u", "v"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["u", "v"])

    return dealt.repartition(partitions(members.sparkSession), "family", "a", "b").sortWithinPartitions("family", "a", "b", "own", "set").transform(in_arrow, meet, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 22, lanes: int = 2, reach: int = 32) -> DataFrame:
    """(id, key, component_id): one row for each row of docs; key is xxhash64 of the text, component_id the smallest id
    that links of similar texts reach."""
    names = _names(lanes)
    node = lambda side: F.struct(*[F.col(f"{side}{k}").alias(n) for k, n in enumerate(names)])
    prints = checkpointed(set_prints(docs, id_col, text_col, width, lanes))
    sets = checkpointed(prints.groupBy("set").agg(F.min("id").alias("least"), F.min(F.struct("key", "size")).alias("one"), *[F.min(c).alias(c) for c in names]))
    near = components(links(checkpointed(sets.select(names).distinct()), radius, reach).select(node("u").alias("u"), node("v").alias("v"))).select(F.col("u").alias("node"), F.col("v").alias("root"))
    # families of equal digests would only be compared together
    placed = sets.withColumn("node", node("fp")).join(near, "node", "left").select(F.xxhash64(F.coalesce("root", "node")).alias("family"), "set", "one.*")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    families = placed.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1").select("family", blocks.alias("blocks"))
    members = checkpointed(placed.join(families, "family").select("family", "blocks", "set", "key"))
    texts = pressed(docs.select(F.xxhash64(text_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))).groupBy("key").agg(F.first("text").alias("text"))
    roots = components(verified(members.join(texts, "key"), width)).select(F.col("u").alias("set"), F.col("v").alias("root"))
    rooted = sets.select("set", "least").join(roots, "set", "left").select("set", F.coalesce("root", "set").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("set", "component_id"), "set").select("id", "key", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **of) -> DataFrame:
    """docs with one document of each group of near copies, the one with the least id.

    Of rows that repeat an id each stays or goes by its own text; of rows that repeat an id and text one stays. Rows without an id stay: no group can
    name them. Rows are looked for twice only if an id occurs twice."""
    found = checkpointed(near_copies(docs, id_col, text_col, **(CORPUS | of)))
    again = found.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    gone = found.where("id != component_id").select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct()
    left = docs.join(gone, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__key")), "left_anti")
    return left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(left.where(F.col(id_col).isNull())) if again else left


def op1_simhash_vptree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
