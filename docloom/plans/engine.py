"""The engine's entry functions: preprocessing, summaries, chunk selection and evaluation of whole corpora at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X
from ..lineage import checkpointed
from ..operators import metrics, pages, vectors
from . import models


def levels(spark: SparkSession) -> DataFrame:
    rows = [(v, n, e, m, t, a, b, s) for v, n, e, m, t, a, b, s in C.LEVELS]
    table = spark.createDataFrame(rows, "value int, name string, emoji string, model string, top_n int, max_length int, min_length int, description string")
    return table.withColumn("target_words", F.floor(F.col("max_length") * 0.75).cast("int"))


def level(value: int) -> dict:
    """The preset of a level; ValueError if there is none."""
    for v, n, e, m, t, a, b, s in C.LEVELS:
        if v == value:
            return {"value": v, "name": n, "emoji": e, "model": m, "top_n": t, "max_length": a, "min_length": b, "description": s, "target_words": int(a * 0.75)}
    raise ValueError(f"no summary level {value}; there are {[x[0] for x in C.LEVELS]}")


def preprocess(page_rows: DataFrame) -> DataFrame:
    """One row a document: what cleaning, typing, sections, sentences and citations of its pages give.

    Typed pages are written once and read by every part; sections, which also give sentences, likewise."""
    typed = checkpointed(pages.classified(page_rows))
    sections = checkpointed(pages.sections(typed))
    ordered = F.array_sort(F.collect_list(F.struct("page_index", "page_type", "text")))
    whole = typed.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.first("header").alias("repeated_header"), ordered.alias("pages"), *[F.count_if(F.col("page_type") == t).alias(t) for t in C.PAGE_TYPES])
    texts = lambda keep: F.transform(F.filter("pages", keep), lambda p: p["text"])
    metadata = texts(lambda p: p["page_type"] == "metadata")
    out = whole.withColumns({"metadata_text": F.array_join(metadata, "\n\n"), "cited": X.citations(F.array_join(texts(lambda p: F.lit(True)), " "))}).drop("pages")
    found = out.select("doc_id", F.posexplode("cited").alias("ord", "citation"))
    at = F.array_position(F.array(*map(F.lit, C.SUMMARY_SECTIONS)), F.col("section"))
    listed = sections.withColumn("at", at).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "section", "text", "page_range"))).alias("sections"), F.sum(F.size(X.within_limit(X.sentences(F.col("text"))))).alias("total_sentences"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("at") > 0) & (F.col("text") != ""), F.struct("at", "section", "text")))), lambda p: F.concat(F.lit("["), F.upper(p["section"]), F.lit("]\n"), p["text"])), "\n\n").alias("summary_text"),
    )
    out = out.drop("cited").join(listed, "doc_id", "left").join(pages.unique_citations(found), "doc_id", "left")
    return out.withColumns({
        "total_sentences": F.coalesce("total_sentences", F.lit(0).cast("long")), "summary_text": F.coalesce("summary_text", F.lit("")),
        "total_found": F.coalesce("total_found", F.lit(0).cast("long")), "unique_citations": F.coalesce("unique_citations", F.array().cast("array<string>")),
    }).withColumn("summary_words", X.word_count(F.col("summary_text")))


def ranked_sentences(page_rows: DataFrame, top_n: int, encode=vectors.hashed) -> DataFrame:
    """(doc_id, section, sid, pos, text, score) of each document's chosen sentences; pos is their place in the document."""
    rows = pages.flattened(pages.sentences(pages.sections(pages.classified(page_rows))))
    questions = [(n, [float(x) for x in v]) for (n, _), v in zip(C.INTENTS, encode([t for _, t in C.INTENTS]))]
    return vectors.select(vectors.embedded(rows, encode=encode), questions, top_n)


def summarize(page_rows: DataFrame, value: int = 4, encode=vectors.hashed, generate: models.Generate | None = None, count: models.Count = models.words) -> DataFrame:
    """(doc_id, summary, output_word_count). Level 4 lists the chosen sentences; others need a generator
    (see `models`), whose summaries' sentences are then grounded."""
    preset = level(value)
    chosen = ranked_sentences(page_rows, preset["top_n"], encode)
    if value == 4:
        parts = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "section", "text"))).alias("s"))
        line = F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), F.upper(x["section"]), F.lit("] "), x["text"]))
        out = parts.select("doc_id", F.array_join(line, "\n").alias("summary"))
    elif generate is None:
        raise NotImplementedError(f"level {value} needs a generator backend ({preset['model']})")
    else:
        known = preprocess(page_rows).select("doc_id", "repeated_header", "metadata_text", "unique_citations")
        text = chosen.groupBy("doc_id").agg(pages.joined("pos", "text", " ").alias("text")).join(known, "doc_id")
        asked = text.select("doc_id", X.metadata_prefix(F.col("repeated_header"), F.col("metadata_text"), F.col("unique_citations")).alias("prefix"), "text")
        made = models.summarized(asked, generate, preset["model"], preset["max_length"], preset["min_length"], count)
        sections = F.filter("unique_citations", lambda c: F.lower(c).startswith("section "))
        allowed = F.concat_ws(" ", "metadata_text", "repeated_header", F.array_join("unique_citations", " "))
        out = made.join(known, "doc_id").select("doc_id", X.grounded(F.col("summary"), allowed, sections).alias("summary"))
    return out.withColumn("output_word_count", X.word_count(F.col("summary")))


def evaluate(pairs: DataFrame, names: tuple[str, ...] = ("rouge", "bertscore", "entailment"), score=models.lexical_score, label=models.lexical_labels) -> DataFrame:
    """pairs (doc_id, source, summary) with the metrics asked for, four decimals each. score and label are the backends of
    the model metrics (see `models`); the built-in ones compare words and are no models. Unknown names are ignored."""
    out = pairs.select("doc_id")
    if "rouge" in names:
        for found in (metrics.rouge1(pairs), metrics.rouge_l(pairs)):
            out = out.join(found.select("doc_id", *[F.round(c, 4).alias(c) for c in found.columns[1:]]), "doc_id")
    if "bertscore" in names:
        out = out.join(models.similarity_scores(pairs, score), "doc_id", "left")
    if "entailment" in names:
        out = out.join(models.entailment_scores(pairs, label), "doc_id", "left")
    return out


def batch_counters(rows: DataFrame) -> DataFrame:
    """(ok, failed): files of a batch by whether they have an error."""
    files = rows.groupBy("filepath").agg(F.max(F.col("error").isNotNull()).alias("bad"))
    return files.agg(F.count_if(~F.col("bad")).alias("ok"), F.count_if("bad").alias("failed"))


class RequestError(ValueError):
    """A request that can't be met; `status` is that of the reply."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def checked_request(filename: str | None, value, size: int, source: str | None = None) -> dict:
    """The preset of a request for a summary, or a RequestError: not a PDF, an unknown level or model source, an empty file."""
    if not (filename or "").lower().endswith(".pdf"):
        raise RequestError(400, "only PDF files are taken")
    if source not in (None, "local", "huggingface"):
        raise RequestError(400, f"unknown model source {source!r}")
    try:
        preset = level(int(value))
    except (TypeError, ValueError) as e:
        raise RequestError(400, str(e)) from None
    if not size:
        raise RequestError(422, "the file is empty")
    return preset


def file_name(stem, value: int):
    """The download name of a summary."""
    return F.concat(F.regexp_replace(stem, r"(?i)\.pdf$", ""), F.lit(f"_{level(value)['name'].lower()}_summary.pdf"))
