"""Vectors: hashed embeddings, centroids, cosine scores, candidates and diverse selection.

chunks: (doc_id, pos, section, embedding). Intents are a fixed handful of vectors that every task holds, so no join is
needed to score them; ranks are windows over one exchange by document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..lineage import checkpointed

DIM = 256


def hashed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A stand-in for a language model: words hashed to signed buckets. Blank texts are zero vectors."""
    out = np.zeros((len(texts), dim), np.float32)
    for k, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            out[k, h % dim] += 1 if h >> 16 & 1 else -1
    return out


def embedded(rows: DataFrame, text_col: str = "text", encode: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """rows with the column `embedding`; encode is any batch encoder (texts to a matrix)."""
    @F.pandas_udf("array<float>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encode(texts.tolist())))

    return rows.withColumn("embedding", of(F.col(text_col)))


def _double(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    a, b = _double(a), _double(b)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def centroid(chunks: DataFrame) -> DataFrame:
    """(doc_id, centroid): means by dimension. Each task sums the vectors of its documents, so a document of any size
    moves one vector a task. Null and empty vectors don't count; a document without others has an empty centroid."""
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def done() -> pa.RecordBatch:
            names, parts = list(held), [held[d] for d in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, key), pa.array([n for n, _ in parts], pa.int64()), pa.array([t.tolist() for _, t in parts], pa.list_(pa.float64()))], ["doc_id", "n", "total"])

        key = None
        for batch in batches:
            key = batch.column(0).type
            for d, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, total = held.get(d, (0, np.zeros(0)))
                if v.is_valid and len(v.values):
                    n, total = n + 1, v.values.to_numpy().astype(np.float64) + (total if n else 0.0)
                held[d] = n, total
            if len(held) > 4096:
                yield done()
        if held:
            yield done()

    parts = chunks.select("doc_id", "embedding").mapInArrow(sums, f"doc_id {kind}, n long, total array<double>").groupBy("doc_id").agg(F.sum("n").alias("n"), F.collect_list("total").alias("parts"))
    total = F.aggregate(F.filter("parts", lambda x: F.size(x) > 0), F.array().cast("array<double>"), lambda s, x: F.when(F.size(s) == 0, x).otherwise(F.zip_with(s, x, lambda a, b: a + b)))
    return parts.select("doc_id", F.transform(total, lambda x: x / F.col("n")).alias("centroid"))


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of token vectors (array of arrays) under a 0/1 mask."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    zero = F.transform(tokens[0], lambda _: F.lit(0.0))
    total = F.aggregate(F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m)), zero, lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def similarities(rows: DataFrame, intents: list[tuple[str, list[float]]]) -> DataFrame:
    """rows (with embedding and centroid) with global_score and intent_scores, the cosines to the centroid and to each
    intent in their order. A matrix product for each Arrow batch: higher-order functions take a step for each number.
    A row whose vector is null, or not as long as the other, has null for that score."""
    units = [np.array(v, np.float64) / (np.linalg.norm(np.array(v, np.float64)) + 1e-9) for _, v in intents]
    columns, dims = [c for c in rows.columns if c not in ("global_score", "intent_scores")], len(units[0]) if units else 0
    at, centre = columns.index("embedding"), columns.index("centroid")

    def matrix(column: pa.Array, of: np.ndarray, d: int) -> np.ndarray:
        return column.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, c = batch.column(at), batch.column(centre)
            long, wide = (pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in (e, c))
            own, each = np.full(batch.num_rows, np.nan), np.zeros((batch.num_rows, len(units)))
            for d in np.unique(long[(long > 0) & (long == wide)]).tolist():
                of = np.nonzero((long == d) & (wide == d))[0]
                x, y = matrix(e, of, d), matrix(c, of, d)
                own[of] = (x * y).sum(1) / ((np.linalg.norm(x, axis=1) + 1e-9) * (np.linalg.norm(y, axis=1) + 1e-9))
            of = np.nonzero(long == dims)[0] if dims else np.zeros(0, np.int64)
            if len(of):
                x = matrix(e, of, dims)
                each[of] = x @ np.stack(units, 1) / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(units)), pa.array(each.ravel()), mask=pa.array(long != dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, mask=np.isnan(own)), lists], [*columns, "global_score", "intent_scores"])

    schema = rows.select(columns).schema.add("global_score", "double").add("intent_scores", T.ArrayType(T.DoubleType()))
    return rows.select(columns).mapInArrow(score, schema)


def scored(chunks: DataFrame, intents: list[tuple[str, list[float]]], global_weight: float = C.GLOBAL_WEIGHT, section_weight: float = C.SECTION_WEIGHT) -> DataFrame:
    """chunks with global_score, intent_scores (array), composite and the hybrid score."""
    boost = F.lit(0.0)
    for name, value in reversed(C.SECTION_BOOSTS):
        boost = F.when(F.contains(F.lower(F.coalesce("section", F.lit(""))), F.lit(name)), value).otherwise(boost)
    both = similarities(chunks.join(centroid(chunks), "doc_id"), intents).drop("centroid")
    mean = F.aggregate("intent_scores", F.lit(0.0), lambda s, x: s + x) / len(intents)
    return both.withColumn("composite", mean).withColumn("score", global_weight * F.col("global_score") + section_weight * F.col("composite") + boost)


def intent_topk(rows: DataFrame, intents: list[tuple[str, list[float]]], k: int) -> DataFrame:
    """(doc_id, intent, rank, pos): the k best chunks of each document for each intent."""
    names = F.array(*[F.lit(n) for n, _ in intents])
    each = rows.select("doc_id", "pos", F.posexplode("intent_scores").alias("i", "s")).withColumn("intent", names[F.col("i")])
    rank = F.row_number().over(Window.partitionBy("doc_id", "intent").orderBy(F.desc("s"), "pos"))
    return each.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("doc_id", "intent", "rank", "pos")


def candidates(rows: DataFrame, intents, top_n: int) -> DataFrame:
    """(doc_id, pos): the 2 top_n best, each intent's best and the last of each document."""
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("pos"))
    last = Window.partitionBy("doc_id").orderBy(F.desc("pos"))
    top = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * top_n).select("doc_id", "pos")
    tail = rows.withColumn("r", F.row_number().over(last)).where(F.col("r") <= C.TAIL).select("doc_id", "pos")
    return top.union(intent_topk(rows, intents, max(3, top_n // 5)).select("doc_id", "pos")).union(tail).distinct()


def drawn(rows: DataFrame, intents, top_n: int) -> DataFrame:
    """The rows of `candidates`, with all their columns: ranks side by side over one exchange by document, no join."""
    k, by = max(3, top_n // 5), Window.partitionBy("doc_id")
    ranks = {"__best": by.orderBy(F.desc("score"), F.desc("pos")), "__last": by.orderBy(F.desc("pos"))}
    ranks |= {f"__{i}": by.orderBy(F.desc(F.col("intent_scores")[i]), "pos") for i in range(len(intents))}
    near = F.lit(False)
    for i in range(len(intents)):
        near = near | (F.col(f"__{i}") <= k)
    ranked = rows.withColumns({name: F.row_number().over(w) for name, w in ranks.items()})
    return ranked.where((F.col("__best") <= 2 * top_n) | (F.col("__last") <= C.TAIL) | near).drop(*ranks)


def select(chunks: DataFrame, intents, top_n: int = 12, threshold: float = C.DIVERSITY) -> DataFrame:
    """The chosen chunks with their columns but the vector, and their score; all (score null) of a document with top_n or fewer."""
    columns = [c for c in chunks.columns if c not in ("embedding", "score")]
    chunks = checkpointed(chunks)  # read again for the centroids; its vectors may come from a model
    sized = chunks.withColumn("__n", F.count("*").over(Window.partitionBy("doc_id")))
    few = sized.where(F.col("__n") <= top_n).select(*columns, F.lit(None).cast("double").alias("score"))
    many = scored(sized.where(F.col("__n") > top_n).drop("__n"), intents)
    best = drawn(many, intents, top_n).select(*columns, "score", "embedding")
    group = best.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "score", F.col("embedding").alias("e"))).alias("c"))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document's candidates (their number is bounded by top_n and the intents)."""
        for batch in batches:
            kept = []
            for row in batch.column(1).to_pylist():
                row.sort(key=lambda x: (-x["score"], x["pos"]))
                units = np.array([x["e"] for x in row], np.float64)
                units /= np.linalg.norm(units, axis=1, keepdims=True) + 1e-9
                chosen: list[int] = []
                for k in range(len(units)):
                    if len(chosen) == top_n:
                        break
                    if not chosen or (units[chosen] @ units[k]).max() <= threshold:
                        chosen.append(k)
                kept.append([row[k]["pos"] for k in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int64()))], ["doc_id", "kept"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    kept = group.mapInArrow(greedy, f"doc_id {kind}, kept array<long>").select(F.col("doc_id").alias("__doc"), F.explode("kept").alias("__pos"))
    return few.unionByName(best.drop("embedding").join(kept, (F.col("doc_id") == F.col("__doc")) & (F.col("pos") == F.col("__pos")), "left_semi"))


def _marked(chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    return chunks.join(chosen.select("doc_id", "pos", F.lit(1).alias("in")), ["doc_id", "pos"], "left")


def selection_stats(chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, total, selected, ratio, total_words, selected_words, word_coverage); chunks have `words`."""
    sums = _marked(chunks, chosen).groupBy("doc_id").agg(F.count("*").alias("total"), F.count("in").alias("selected"), F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"), F.coalesce(F.sum(F.when(F.col("in") == 1, F.col("words"))), F.lit(0)).alias("selected_words"))
    return sums.withColumns({"ratio": F.col("selected") / F.col("total"), "word_coverage": F.coalesce(F.col("selected_words") / F.nullif("total_words", F.lit(0)), F.lit(0.0))})


def section_distribution(chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, section, n): how many of a document's chosen chunks each section has; `unknown` where there is none."""
    return _marked(chunks, chosen).where(F.col("in") == 1).groupBy("doc_id", F.coalesce("section", F.lit("unknown")).alias("section")).agg(F.count("*").alias("n"))
