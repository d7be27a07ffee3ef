"""Models as plug-ins: a registry, the generator's settings, summaries of texts of any length, and scorers of summaries.

No model ships. A backend is a plain function over a batch of texts; it is loaded once in each worker, by name from the
registry, and runs in Arrow batches. What is around it (token budgets, groups, limits, means, ratios) is done here.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics

# Tokens that a generator reads and a decoder writes, its beam search, and the order of the NLI labels
INPUT_MAX = {"led": 16384, "pegasus": 1024}
DECODER_POSITIONS = 1024
SEARCH = {"num_beams": 4, "length_penalty": 1.0, "no_repeat_ngram_size": 2, "repetition_penalty": 1.1, "do_sample": False, "early_stopping": True}
GLOBAL_FIRST, GLOBAL_LAST, MARGIN, GROUP_MAX, GROUP_MIN = 64, 32, 32, 80, 30
NLI_LABELS = ["contradiction", "neutral", "entailment"]
# -----------------------------------------------------------------------------------------------------------------

#: generate(texts, settings) gives a summary of each; count(texts) the tokens of each.
Generate = Callable[[list[str], dict], list[str]]
Count = Callable[[list[str]], list[int]]

_LOADERS: dict[str, Callable[[], object]] = {}


def register(key: str, load: Callable[[], object]) -> None:
    """Names a model's loader; the model is loaded where and when it is first used."""
    _LOADERS[key] = load
    model.cache_clear()


@functools.lru_cache(maxsize=4)
def model(key: str):
    """The model of a key, loaded once in this process; ValueError for an unknown key."""
    if key not in _LOADERS:
        raise ValueError(f"no model {key!r}; there are {sorted(_LOADERS)}")
    return _LOADERS[key]()


def words(texts: list[str]) -> list[int]:
    """A stand-in for a tokenizer: tokens are words."""
    return [len(t.split()) for t in texts]


def settings(key: str, max_length: int, min_length: int, n_tokens: int | None = None, positions: int = DECODER_POSITIONS) -> dict:
    """What a generator of this kind is called with. The decoder keeps two places for the ends of a text."""
    most = min(max_length, positions - 2)
    out = {"max_new_tokens": most, "min_new_tokens": max(1, min(min_length, most // 2)), **SEARCH}
    if key == "led" and n_tokens is not None:
        first, last = min(GLOBAL_FIRST, n_tokens), max(0, n_tokens - GLOBAL_LAST)
        out["global_attention"] = [*range(first), *range(max(first, last), n_tokens)]
    return out


def counted(rows: DataFrame, column: str, name: str, count: Count = words) -> DataFrame:
    """rows with the tokens of each text of a column: a string, or an array of strings (then an array of counts)."""
    many = rows.schema[column].dataType.simpleString().startswith("array")

    @F.pandas_udf("array<int>" if many else "int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else count(list(t))) if many else pd.Series(count([t or "" for t in texts]))

    return rows.withColumn(name, of(F.col(column)))


def packed(sentences: Column, tokens: Column, budget: Column) -> Column:
    """Neighbouring sentences together, by spaces, while their tokens are within the budget; a larger one stands alone."""
    pairs = F.zip_with(sentences, tokens, lambda s, n: F.struct(s.alias("s"), n.cast("long").alias("n")))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] + x["n"] > budget) & (F.size(a["held"]) > 0)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(F.array_join(a["held"], " ")))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(x["s"])).otherwise(F.concat(a["held"], F.array(x["s"]))).alias("held"), F.when(full, x["n"]).otherwise(a["n"] + x["n"]).alias("n"),
        )

    return F.aggregate(pairs, state, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["done"], F.array(F.array_join(a["held"], " ")))).otherwise(a["done"]))


def split_ends(text: Column) -> Column:
    """At white space behind the end of a sentence."""
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def groups(texts: DataFrame, input_max: int, count: Count = words, text_col: str = "text", prefix_col: str = "prefix") -> DataFrame:
    """texts with `groups`: sentences packed to what the model reads beside the prefix, less a margin."""
    cut = counted(counted(texts.withColumn("__s", split_ends(F.col(text_col))), "__s", "__n", count), prefix_col, "__p", count)
    return cut.withColumn("groups", packed(F.col("__s"), F.col("__n"), input_max - F.col("__p") - MARGIN)).drop("__s", "__n", "__p")


def summarized(texts: DataFrame, generate: Generate, key: str = "led", max_length: int = 350, min_length: int = 100, count: Count = words, input_max: int | None = None) -> DataFrame:
    """texts (doc_id, prefix, text) as (doc_id, summary). A blank text has an empty summary. What the model can read with its
    prefix goes in one pass; else groups of sentences are summarised each, and the summaries again if they fit, or joined if
    they don't. All group summaries empty: the whole text in one pass, as far as the model reads."""
    limit, kind = input_max or INPUT_MAX[key], texts.schema["doc_id"].dataType.simpleString()

    def once(items: list[str], most: int, least: int) -> list[str]:
        if not items:
            return []
        return [s.strip() for s in generate(items, settings(key, most, least))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for prefix, text, parts, n in zip(*(batch.column(c).to_pylist() for c in range(1, 5))):
                prefix, text = prefix or "", text or ""
                if not text.strip():
                    out.append("")
                elif n <= limit:
                    out += once([prefix + text], max_length, min_length)
                else:
                    g = max(1, len(parts))
                    made = [s for s in once([prefix + p for p in parts], max(GROUP_MAX, max_length // g), max(GROUP_MIN, min_length // g)) if s]
                    merged = " ".join(made)
                    if not made:
                        out += once([prefix + text], max_length, min_length)
                    elif count([prefix + merged])[0] <= limit:
                        out += once([prefix + merged], max_length, min_length)
                    else:
                        out.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "summary"])

    whole = F.concat(F.coalesce("prefix", F.lit("")), F.coalesce("text", F.lit("")))
    rows = counted(groups(texts.withColumns({"prefix": F.coalesce("prefix", F.lit("")), "text": F.coalesce("text", F.lit(""))}), limit, count).withColumn("__whole", whole), "__whole", "n", count)
    made = rows.select("doc_id", "prefix", "text", "groups", "n").mapInArrow(run, f"doc_id {kind}, summary string")
    return made.withColumn("summary", F.when(F.col("summary") != "", X.decode_cleanup(F.col("summary"))).otherwise(""))


def lexical_score(sources: list[str], summaries: list[str]) -> list[tuple[float, float]]:
    """A stand-in for token embeddings: a token is matched by an equal one alone. (precision, recall) of each pair."""
    out = []
    for a, b in zip(sources, summaries):
        a, b = a.split(), b.split()
        known, said = set(a), set(b)
        out.append((sum(w in known for w in b) / len(b) if b else 0.0, sum(w in said for w in a) / len(a) if a else 0.0))
    return out


def similarity_scores(pairs: DataFrame, score: Callable[[list[str], list[str]], list[tuple[float, float]]] = lexical_score, n: int = 300) -> DataFrame:
    """(doc_id, bertscore_precision, _recall, _f1): means over the blocks of `metrics.block_pairs`, four decimals."""
    @F.pandas_udf("struct<p:double,r:double>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame(score(a.fillna("").tolist(), b.fillna("").tolist()), columns=["p", "r"])

    each = metrics.block_pairs(pairs, n).withColumn("x", of("source_text", "summary_text"))
    f = F.when(F.col("x.p") + F.col("x.r") > 0, 2 * F.col("x.p") * F.col("x.r") / (F.col("x.p") + F.col("x.r"))).otherwise(0.0)
    means = {"bertscore_precision": F.avg("x.p"), "bertscore_recall": F.avg("x.r"), "bertscore_f1": F.avg(f)}
    return each.groupBy("doc_id").agg(*[F.round(v, 4).alias(k) for k, v in means.items()])


def inference_pairs(pairs: DataFrame, n: int = 400) -> DataFrame:
    """(doc_id, ord, source_text, sentence): each sentence of a summary beside the first n words of its source; ord null and
    no sentence for a summary without any."""
    cut = pairs.select("doc_id", X.truncated(F.col("source"), n).alias("source_text"), F.posexplode_outer(X.evaluation_sentences(F.col("summary"))).alias("ord", "sentence"))
    return cut.select("doc_id", F.col("ord").cast("long").alias("ord"), "source_text", "sentence")


def lexical_labels(sources: list[str], sentences: list[str]) -> list[int]:
    """A stand-in for an NLI model, as places in NLI_LABELS: entailment where half the words are the source's, else neutral."""
    return [2 if sum(w in known for w in s.split()) * 2 >= len(s.split()) else 1 for known, s in zip((set(a.split()) for a in sources), sentences)]


def entailment_scores(pairs: DataFrame, label: Callable[[list[str], list[str]], list[int]] = lexical_labels) -> DataFrame:
    """(doc_id, entailment_ratio, contradiction_ratio, neutral_ratio, num_sentences_evaluated), four decimals."""
    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            some = b.notna()
            out = pd.Series([None] * len(b), dtype=object)
            if some.any():
                out[some.to_numpy()] = [NLI_LABELS[k] for k in label(a[some].fillna("").tolist(), b[some].tolist())]
            yield out

    found = metrics.entailment_ratios(inference_pairs(pairs).withColumn("label", of("source_text", "sentence")))
    return found.select("doc_id", *[F.round(c, 4).alias(c) for c in found.columns[1:4]], "num_sentences_evaluated")
