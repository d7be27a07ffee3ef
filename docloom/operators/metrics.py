"""Quality of summaries: ROUGE, block pairs for a scorer, entailment ratios."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.porter import stem


def rouge_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " +"), lambda w: w != "")


def _scores(hits: Column, n_source: Column, n_summary: Column, name: str) -> list[Column]:
    p, r = F.coalesce(hits / F.nullif(n_summary, F.lit(0)), F.lit(0.0)), F.coalesce(hits / F.nullif(n_source, F.lit(0)), F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [p.alias(f"{name}_precision"), r.alias(f"{name}_recall"), f.alias(f"{name}_f1")]


def stemmed(tokens: DataFrame, column: str = "token") -> DataFrame:
    """Tokens stemmed once for each distinct one."""
    @F.pandas_udf("string")
    def of(words: pd.Series) -> pd.Series:
        return words.map(lambda w: stem(w) if len(w) > 3 else w)

    stems = tokens.select(column).distinct().withColumn("stem", of(F.col(column)))
    return tokens.join(stems, column).drop(column).withColumnRenamed("stem", column)


def rouge1(pairs: DataFrame, stemming: bool = True) -> DataFrame:
    """pairs: (doc_id, source, summary)."""
    def counts(side: str) -> DataFrame:
        tokens = pairs.select("doc_id", F.explode(rouge_tokens(F.col(side))).alias("token"))
        return (stemmed(tokens) if stemming else tokens).groupBy("doc_id", "token").agg(F.count("*").alias(side[:2] + "n"))

    both = counts("source").join(counts("summary"), ["doc_id", "token"], "full")
    sums = both.groupBy("doc_id").agg(F.sum(F.least(F.coalesce("son", F.lit(0)), F.coalesce("sun", F.lit(0)))).alias("hits"), F.coalesce(F.sum("son"), F.lit(0)).alias("ns"), F.coalesce(F.sum("sun"), F.lit(0)).alias("nm"))
    all_docs = pairs.select("doc_id").join(sums, "doc_id", "left").fillna(0, ["hits", "ns", "nm"])
    return all_docs.select("doc_id", *_scores(F.col("hits"), F.col("ns"), F.col("nm"), "rouge1"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each place of a."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        at = row & where.get(w, 0)
        row = (row + at | row - at) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, stemming: bool = True) -> DataFrame:
    @F.pandas_udf("long")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        shape = (lambda ws: [stem(w) if len(w) > 3 else w for w in ws]) if stemming else list
        return pd.Series([lcs(shape(x), shape(y)) for x, y in zip(a, b)])

    t = pairs.select("doc_id", rouge_tokens(F.col("source")).alias("a"), rouge_tokens(F.col("summary")).alias("b"))
    return t.withColumn("hits", of("a", "b")).select("doc_id", *_scores(F.col("hits"), F.size("a"), F.size("b"), "rougeL"))


def block_pairs(pairs: DataFrame, n: int = 300) -> DataFrame:
    """(doc_id, block, source_block, source_text, summary_text): summary block i against source block min(i, last)."""
    t = pairs.select("doc_id", X.blocks(F.col("source"), n).alias("a"), F.posexplode(X.blocks(F.col("summary"), n)).alias("i", "summary_text"))
    at = F.least(F.col("i"), F.size("a") - 1)
    return t.select("doc_id", F.col("i").cast("long").alias("block"), at.cast("long").alias("source_block"), F.col("a")[at].alias("source_text"), "summary_text")


def entailment_ratios(predictions: DataFrame) -> DataFrame:
    """predictions: (doc_id, label) of summary sentences, label null for a document without any."""
    share = lambda x: F.coalesce(F.avg((F.col("label") == x).cast("int")), F.lit(0.0)).alias(f"{x}_ratio")
    return predictions.groupBy("doc_id").agg(share("entailment"), share("contradiction"), share("neutral"), F.count("label").alias("num_sentences_evaluated"))
