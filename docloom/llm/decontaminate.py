"""Benchmark decontamination: pigeonhole edit matching.

Texts and items are compared in lower case with every run of white space as one space. An item of m characters is found
in a text where a stretch of it is within k = floor(m * RATE) edits. Of k + 1 pieces of the item one must then occur
unchanged: all pieces go to an Aho-Corasick automaton, each hit fixes where the item would lie, give or take k, and
Myers' bit-parallel distance over that stretch decides. No candidate is left out.

The items are the benchmark's, a query set of its own size and not the corpus's: they are taken in blocks of at most
BLOCK_CHARS characters, each with an automaton of bounded size that is broadcast; every block runs against all rows.

Defined results: null or blank items match nothing; null and empty texts match nothing. Equal items with different ids
are each reported; items without an id with a null one. Repeated rows are reported as often. Empty tables give no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_arrow

RATE, BLOCK_CHARS = 0.08, 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """(error budget k, the k + 1 pieces with their places)."""
    k = int(len(item) * rate)
    ends = [len(item) * j // (k + 1) for j in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def myers(item: str, text: str) -> tuple[int, int]:
    """(least edit distance between the item and a stretch of the text, end of the first such stretch)."""
    m, peq = len(item), {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """Items ready for texts. items: (id of any type, normalised text)."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE):
        pieces: dict[str, list[tuple[int, int]]] = {}
        self.items, self.k = items, []
        for n, (_, text) in enumerate(items):
            k, parts = cut(text, rate)
            self.k.append(k)
            for at, piece in parts:
                pieces.setdefault(piece, []).append((n, at))
        self.found = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.found.add_word(piece, (len(piece), where))
        self.found.make_automaton()

    def __call__(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, edits, start, end in the normalised text) of every item's best stretch, within its budget: the first
        end with the least edits, and the shortest stretch with these edits that ends there."""
        spots: dict[int, list[int]] = {}
        for end, (size, where) in self.found.iter(text):
            for n, at in where:
                spots.setdefault(n, []).append(end + 1 - size - at)
        out = []
        for n, starts in spots.items():
            (name, item), k, best = self.items[n], self.k[n], None
            starts, at = sorted(set(starts)), 0
            while at < len(starts) and (best is None or best[1]):
                first = last = starts[at]
                at += 1
                while at < len(starts) and starts[at] - last <= 2 * k:
                    last = starts[at]
                    at += 1
                a, b = max(0, first - k), last + len(item) + k
                stretch = text[a:b]
                place = stretch.find(item)
                edits, end = (0, place + len(item)) if place >= 0 else myers(item, stretch)
                if edits <= k and (best is None or edits < best[1]):
                    best = (name, edits, a + end, a)
            if best:
                name, edits, end, least = best
                # the shortest match that ends there: the same search backwards
                back = text[max(least, end - len(item) - k) : end][::-1]
                out.append((name, edits, end - (myers(item[::-1], back)[1] if edits else len(item)), end))
        return sorted(out, key=lambda h: (h[0] is not None, h))


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size; one block is on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        text = normal(row[1])
        if text:
            block.append((row[0], text))
            size += len(text)
            if size >= BLOCK_CHARS:
                yield block
                block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """(id, item_id, edits, start, end): each item that a text holds, with the place in the normalised text."""
    kind, rows = docs.schema[id_col].dataType.simpleString(), docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item_id {benchmark.schema[item_col].dataType.simpleString()}, edits int, start int, end int"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)

    def against(block: list[tuple[object, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Matcher(shared.value, rate)
            for batch in batches:
                hits = [(k, *h) for k, t in enumerate(batch.column(1).to_pylist()) if t for h in found(normal(t))]
                take = pa.array([h[0] for h in hits], pa.int64())
                rest = [[h[c] for h in hits] for c in range(1, 5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(rest[0], item_type), *(pa.array(r, pa.int32()) for r in rest[1:])], ["id", "item_id", "edits", "start", "end"])

        return rows.transform(in_arrow, match, schema)

    parts = [against(b) for b in item_blocks(benchmark, item_col, item_text)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """docs without the rows that hold an item; all columns stay, and no id is needed."""
    def against(rows: DataFrame, block: list[tuple[object, str]]) -> DataFrame:
        shared, at = rows.sparkSession.sparkContext.broadcast(block), rows.columns.index(text_col)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not (t and found(normal(t))) for t in batch.column(at).to_pylist()], pa.bool_()))

        return rows.transform(in_arrow, keep, rows.schema)

    return reduce(against, item_blocks(benchmark, "item_id", "text"), docs)


def op3_edit_leaks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")
