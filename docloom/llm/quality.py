"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features, and a softmax over that average gives its label. Features
are hashed to BUCKETS: words (cut at white space), the event that a word repeats the one before, and 3- to 5-grams of characters, upper and lower case apart. Vectors and output
weights are trained by stochastic gradient descent in numpy, in one task, on a bounded sample of labelled rows (MAX_LABELLED);
a document enters as its feature counts, so a very long text costs BUCKETS numbers at most. The model (BUCKETS x DIM
floats) is broadcast; scoring multiplies sparse counts by it, batch by batch, over whole texts.

Scores are calibrated to what the training labels say: equal weight for each training row.

Defined results: a null or blank text has no features and gets the score of the intercept alone (the base rate). Labels
of documents that occur several times count each time. No labels at all: every score is 0.5. Very long texts are read
whole, in pieces with the same features. Other columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .language import bounded

BUCKETS, DIM, EPOCHS, RATE, SEED, PIECE, THRESHOLD = 1 << 15, 8, 6, 0.5, 7, 1 << 18, 0.3
#: Labelled rows to learn from, about; taken by a hash of the id.
MAX_LABELLED = 10_000


def _mixed(h, x):
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x * np.uint32(0x9E3779B1)


def _grams(c: np.ndarray, behind: int = 0) -> list[np.ndarray]:
    """Hashes of the 3- to 5-grams of characters, but for those that begin in the last `behind` characters."""
    n = len(c) - behind
    if len(c) < 3 or n < 1:
        return []
    h = _mixed(_mixed(np.full(1, 3, np.uint32), c[:-1]), c[1:])
    out = []
    for k in (3, 4, 5):
        if len(c) < k:
            break
        h = _mixed(h[: len(c) - k + 1], c[k - 1 :])
        out.append(h[:n])
    return out


class _Words:
    """Hashes of the words of a text that comes in pieces: a sum over a word's characters times powers, mixed with its length."""

    def __init__(self):
        self.sum, self.size, self.last = np.uint32(0), 0, None  # of the word that is open; the word before

    def __call__(self, c: np.ndarray, end: bool) -> list[np.ndarray]:
        word = c != 32
        begin = np.nonzero(word & ~np.append(self.size > 0, word[:-1]))[0]
        close = np.nonzero(~word & np.append(self.size > 0, word[:-1]))[0]  # the space behind a word
        at = np.arange(len(c)) + self.size
        if len(begin):
            at[begin[0] :] = np.arange(begin[0], len(c)) - np.repeat(begin, np.diff(np.append(begin, len(c))))
        weighed = np.where(word, (c ^ np.uint32(0x5BD1E995)) * _POWERS[np.minimum(at, 255)], np.uint32(0))
        total = np.append(np.uint32(0), np.cumsum(weighed, dtype=np.uint32))
        if self.size:
            sums, sizes = total[close] - np.append(np.uint32(-int(self.sum) & 0xFFFFFFFF), total[begin])[: len(close)], close - np.append(-self.size, begin)[: len(close)]
        else:
            sums, sizes = total[close] - total[begin[: len(close)]], close - begin[: len(close)]
        if len(c) and word[-1]:
            first = int(begin[-1]) if len(begin) else 0
            carried, before = (np.uint32(0), 0) if len(begin) else (self.sum, self.size)
            self.sum, self.size = np.uint32((int(carried) + int(total[-1]) - int(total[first])) & 0xFFFFFFFF), before + len(c) - first
        elif len(c):
            self.sum, self.size = np.uint32(0), 0
        if end and self.size:
            sums, sizes = np.append(sums, self.sum), np.append(sizes, self.size)
        words = _mixed(sums.astype(np.uint32), sizes.astype(np.uint32))
        if not len(words):
            return []
        before = words[:-1] if self.last is None else np.append(self.last, words[:-1])
        again = np.count_nonzero(words[len(words) - len(before) :] == before)
        self.last = words[-1:]
        return [words, np.full(again, _AGAIN)]


def _features(text: str, piece: int = 0) -> Iterator[np.ndarray]:
    """Buckets of the features of a whole text, piece by piece. Pieces share characters, and words go on in the next, so
    that together they are what the text has in one piece."""
    piece = piece or PIECE
    plain, words = f" {' '.join(text.split())} ", _Words()
    if len(plain) < 3:
        return
    for i in range(0, len(plain), piece):
        part = plain[i : i + piece + 4]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        behind = max(0, len(part) - piece)
        found = _grams(c, behind) + words(c[: len(c) - behind], i + piece >= len(plain))
        if found:
            yield np.concatenate(found) >> np.uint32(17)


#: The feature of a word that repeats the one before it.
_AGAIN = np.uint32(0x2545F491)
_POWERS = np.cumprod(np.full(256, 0x01000193, np.uint64) % (1 << 32), dtype=np.uint64).astype(np.uint32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights that sum to 1) of a whole text."""
    if not text or not text.strip():
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    total = np.zeros(BUCKETS, np.int64)
    for found in _features(text):
        total += np.bincount(found, minlength=BUCKETS)
    at = np.nonzero(total)[0]
    return at, (total[at] / total[at].sum()).astype(np.float32) if len(at) else np.zeros(0, np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, output weights, intercepts) by stochastic gradient descent, a document a step, falling rate."""
    rng = np.random.default_rng(SEED)
    vectors, out, base = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM, np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    if not rows:
        return vectors, out, base
    share = np.bincount([y for _, _, y in rows], minlength=2) + 0.5
    base[:] = np.log(share / share.sum())
    whole = vectors.view(f"V{4 * DIM}").ravel()  # a vector as one item: taken and put back at once
    scale = np.float32(np.sqrt(BUCKETS))  # features of an averaged document are tiny: their vectors move faster
    for e in range(EPOCHS):
        rate = np.float32(RATE * (1 - e / EPOCHS))
        for k in rng.permutation(len(rows)):
            at, w, y = rows[k]
            if not len(at):
                continue
            own = whole[at].view(np.float32).reshape(-1, DIM)
            hidden = w @ own
            z = hidden @ out + base
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            own -= np.multiply.outer((rate * scale * 0.2) * w, back)
            whole[at] = own.view(whole.dtype).ravel()
    return vectors, out, base


def train(labelled: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "label", most: int = MAX_LABELLED):
    """labelled: (key, text, label 0 or 1). Features are made where the rows are, the model in one task; no text moves."""
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [features(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([a.astype(np.int16).tobytes() for a, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())], ["key", "label", "at", "w"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(k, np.frombuffer(a, np.int16).astype(np.int64), np.frombuffer(w, np.float32), y) for b in batches for k, y, a, w in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: (r[0], r[3], len(r[1])))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in fit([r[1:] for r in rows])], ["v", "o", "b"])

    known = bounded(labelled.where(F.col(label_col).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")), "key", most)
    rows = known.select("key", "text", "label").transform(in_arrow, sparse, "key string, label int, at binary, w binary").repartition(1).transform(in_arrow, learn, "v binary, o binary, b binary").collect()
    if not rows:
        return fit([])
    v, o, b = (np.frombuffer(x, np.float32) for x in rows[0])
    return v.reshape(BUCKETS, DIM), o.reshape(DIM, 2), b


def score(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """docs with `score` (of label 1) added; an earlier column of that name is replaced."""
    columns = [c for c in docs.columns if c != "score"]
    shared, at = docs.sparkSession.sparkContext.broadcast(model), columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, out, base = shared.value
        lead = (vectors @ out) @ np.array([-1, 1], np.float32)  # how far a bucket puts label 1 ahead of label 0
        for batch in batches:
            p = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column(at).to_pylist()):
                total, n = 0.0, 0
                for found in _features(text or ""):
                    total, n = total + float(lead[found].sum(dtype=np.float64)), n + len(found)
                p[k] = 1 / (1 + np.exp(-np.clip(total / max(1, n) + float(base[1] - base[0]), -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    return docs.select(columns).transform(in_arrow, of, docs.select(columns).schema.add("score", "double"))


def op8_quality_embeddings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality in (0, 1)").select("doc_id", F.col("quality").alias("label"))
    chosen = bounded(labels.where(~held), "doc_id", MAX_LABELLED)  # of the labels first: texts of others aren't read into the join
    model = train(docs.join(F.broadcast(chosen), "doc_id"))
    scored = score(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
