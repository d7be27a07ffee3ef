"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 1- to 3-grams of a text's characters (letters in lower case, every run of other characters one space),
hashed to BUCKETS. Training counts n-grams by language in numpy, adds them up inside each task, and Spark sums the
(language, bucket) cells; the smoothed log-probability matrix (languages x BUCKETS) is broadcast. Its size is bounded:
more than MAX_LANGS languages are refused. Scoring gathers the matrix rows of a text's n-grams, batch by batch.

The score is the posterior of the predicted language with the text's evidence tempered to TEMPER n-grams, so that long
texts don't all score 1.

Defined results: a null text, or one without a letter, is `und` with score 0. Texts of unknown n-grams get the prior's
language. Rows without a language don't train. No training rows at all: every text is `und` with score 0. Repeated rows
count as often as they come. Whole texts are read, long ones in pieces of PIECE characters with the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

BUCKETS, SMOOTH, TEMPER, MAX_LANGS, PIECE = 1 << 16, 0.1, 200.0, 512, 1 << 18
#: Labelled rows that train the model: about so many, taken by a hash of the id. A bound of training alone.
MAX_TRAINING = 200_000


def _letter(code: int) -> int:
    """The lower-case letter of a code point, or a space if it is none."""
    low = chr(code).lower()
    return (ord(low) if len(low) == 1 else code) if chr(code).isalpha() else 32


#: Of every code point of the basic plane.
_LETTER = np.array([_letter(c) for c in range(1 << 16)], np.uint32)


def _codes(text: str) -> np.ndarray:
    """Of each character its lower-case letter, or a space."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) and c.max() >> 16:
        rare = c >> 16 > 0
        known, at = np.unique(c[rare], return_inverse=True)
        out = _LETTER[np.where(rare, 32, c)]
        out[rare] = np.array([_letter(int(k)) for k in known], np.uint32)[at]
        return out
    return _LETTER[c]


def _once(c: np.ndarray) -> np.ndarray:
    """With one space for each run of spaces."""
    space = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return c[keep]


def _grams(c: np.ndarray, known: int = 0) -> np.ndarray:
    """Bucket numbers of the 1- to 3-grams of letters that end behind the first `known` (2 at most) of them."""
    h1 = c * np.uint32(0x9E3779B1)
    h2 = (h1[:-1] ^ (h1[:-1] >> 15)) * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35)
    h3 = (h2[:-1] ^ (h2[:-1] >> 13)) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
    return np.concatenate([h >> np.uint32(16) for h in (h1[known:], h2[max(0, known - 1) :], h3)])


def counts_of(text: str | None, piece: int = PIECE) -> np.ndarray | None:
    """The bucket numbers of a short text, how often each bucket occurs for a long one; None if it has no letter.

    Pieces carry the last two letters over, so that the counts are those of the whole text."""
    if text and len(text) <= piece:
        c = _once(_codes(f" {text} "))
        return _grams(c) if len(c) > 1 else None
    total, last, some = np.zeros(BUCKETS, np.int64), np.zeros(0, np.uint32), False
    for i in range(0, len(text or ""), piece):
        part = text[i : i + piece]
        c = _once(np.concatenate([last, _codes(f" {part}" if not i else part), _LETTER[[32]][: i + piece >= len(text)]]))
        total += np.bincount(_grams(c, len(last)), minlength=BUCKETS)
        some, last = some or len(c) > 1, c[-2:]
    return total if some else None


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities: a row a bucket, a last row of log priors), from all rows with a language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = cells.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                if len(cells) > MAX_LANGS:
                    raise ValueError(f"more than {MAX_LANGS} languages")
                own[BUCKETS] += 1
                found = counts_of(text)
                if found is not None:
                    own[:BUCKETS] += found if len(found) == BUCKETS and found.dtype == np.int64 else np.bincount(found, minlength=BUCKETS)
        for lang, own in cells.items():
            at = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = known.transform(in_arrow, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    n = np.zeros((BUCKETS + 1, len(langs)))
    if langs:
        n[sums.column("bucket").to_numpy(), np.searchsorted(np.array(langs), np.array(sums.column("lang").to_pylist()))] = sums.column("n").to_numpy()
    grams = n[:BUCKETS] + SMOOTH
    table = np.log(np.concatenate([grams / grams.sum(0), n[BUCKETS:] / max(1, n[BUCKETS:].sum())]) + 1e-300)
    return langs, table.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added (columns of those names are replaced)."""
    spark, columns = docs.sparkSession, [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)
    at = columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in batches:
            best, sure = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(at).to_pylist()):
                found = counts_of(text) if langs else None
                if found is None:
                    continue
                if len(found) == BUCKETS and found.dtype == np.int64:
                    n, logs = found.sum(), (found @ table[:BUCKETS].astype(np.float64))
                else:
                    n, logs = len(found), table[found].sum(0, dtype=np.float64)
                logs = logs * min(1.0, TEMPER / n) + table[BUCKETS]
                p = np.exp(logs - logs.max())
                best[k], sure[k] = langs[int(p.argmax())], p.max() / p.sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(sure)], [*batch.schema.names, "lang_pred", "score"])

    return docs.select(columns).transform(in_arrow, score, docs.select(columns).schema.add("lang_pred", "string").add("score", "double"))


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bounded(rows: DataFrame, key: str, most: int = MAX_TRAINING) -> DataFrame:
    """About `most` rows at most, by a hash of the key: the same rows whenever the table is the same."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(key, F.lit(6)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def op6_language_nb(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(bounded(docs.where(~_held_out(F.col("doc_id")) & F.col("lang").isNotNull()), "doc_id"))
    return predict(docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
