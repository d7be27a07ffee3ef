"""Pages of documents: statistics, repeated headers, types, sections and citations.

pages: (doc_id, page_index, text). Sections, histograms and texts need a document's pages together; what is gathered for
a key is one document's pages, and statistics and headers are aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X


def joined(order: str, text: str, by: str) -> F.Column:
    """The texts of a group in order, as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), by)


def doc_stats(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("num_pages"), F.sum(F.length("text")).cast("long").alias("total_characters"), F.avg(F.length("text")).alias("avg_chars_per_page"))


def text_based(pages: DataFrame, sample: int = 3) -> DataFrame:
    """Over 100 stripped characters a page among the first pages; a document without any of them is not text-based."""
    size = F.when(F.col("page_index") < sample, F.length(X.strip(F.col("text"))))
    return pages.groupBy("doc_id").agg(F.coalesce(F.avg(size) > 100, F.lit(False)).alias("is_text_based"))


def ocr_confidence(pages: DataFrame) -> DataFrame:
    """Mean over pages with a confidence other than 0, where the first page is read by OCR."""
    first = F.min_by("extraction_method", "page_index")
    return pages.groupBy("doc_id").agg(F.when(first == "ocr", F.avg(F.when(F.col("ocr_confidence") != 0, F.col("ocr_confidence")))).alias("ocr_avg_confidence"))


def repeated_header(pages: DataFrame) -> DataFrame:
    """(doc_id, header): the commonest first line, the first seen on ties, if half the pages have it; else null."""
    line = X.strip(F.split(X.strip(F.col("text")), "\n")[0])
    lines = pages.select("doc_id", "page_index", F.when(X.strip(F.col("text")) != "", line).alias("line"))
    counted = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.min("page_index").alias("at"))
    best = F.max_by(F.struct("line", "n"), F.when(F.col("line").isNotNull(), F.struct("n", -F.col("at"))))
    found = counted.groupBy("doc_id").agg(F.sum("n").alias("pages"), best.alias("b"))
    fits = (F.col("pages") >= 2) & (F.col("b.n") >= F.floor(F.col("pages") / 2)) & (F.length("b.line") > 20)
    return found.select("doc_id", F.when(fits, F.col("b.line")).alias("header"))


def cleaned(pages: DataFrame) -> DataFrame:
    return pages.join(repeated_header(pages), "doc_id").withColumn("text", X.clean(F.coalesce("text", F.lit("")), F.col("header")))


def classified(pages: DataFrame) -> DataFrame:
    """Cleaned pages with page_type; header stays as a column."""
    return cleaned(pages).withColumn("page_type", X.page_type(F.col("text"), F.col("page_index")))


def histogram(typed: DataFrame) -> DataFrame:
    return typed.groupBy("doc_id").agg(*[F.count_if(F.col("page_type") == t).alias(t) for t in C.PAGE_TYPES])


def sections(typed: DataFrame) -> DataFrame:
    """(doc_id, ord, section, text, page_range): runs of pages from one typed page to the next, joined by section name."""
    pages = Window.partitionBy("doc_id").orderBy("page_index")
    start = ~F.col("page_type").isin("unknown", "metadata")
    runs = typed.withColumn("start", start).withColumn("run", F.sum(F.col("start").cast("int")).over(pages)).where("run > 0")
    closed = runs.groupBy("doc_id", "run").agg(F.max_by("page_type", F.when(F.col("start"), 1)).alias("section"), joined("page_index", "text", "\n").alias("text"), F.min("page_index").alias("first"), F.max("page_index").alias("last"))
    closed = closed.withColumn("closes", F.coalesce(F.lead("first").over(Window.partitionBy("doc_id").orderBy("run")), "last"))
    named = closed.groupBy("doc_id", "section").agg(F.min("run").alias("first_run"), joined("run", "text", "\n\n").alias("text"), F.transform(F.array_sort(F.collect_list(F.struct("run", "closes"))), lambda x: x["closes"].cast("long")).alias("page_range"))
    return named.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_run")).cast("long").alias("ord"), "section", X.normal_space(F.col("text")).alias("text"), "page_range")


def summary_text(found: DataFrame) -> DataFrame:
    """(doc_id, text): non-blank sections but dissent under their markers, in the fixed order."""
    at = F.array_position(F.array(*map(F.lit, C.SUMMARY_SECTIONS)), F.col("section"))
    kept = found.withColumn("at", at).where("at > 0 and text != ''").withColumn("part", F.concat(F.lit("["), F.upper("section"), F.lit("]\n"), "text"))
    return kept.groupBy("doc_id").agg(joined("at", "part", "\n\n").alias("text"))


def metadata_text(typed: DataFrame) -> DataFrame:
    return typed.where("page_type = 'metadata'").groupBy("doc_id").agg(joined("page_index", "text", "\n\n").alias("metadata_text"))


def citations(typed: DataFrame) -> DataFrame:
    """(doc_id, ord, citation): all of a document, pattern by pattern, then by place."""
    whole = typed.groupBy("doc_id").agg(joined("page_index", "text", " ").alias("text"))
    return whole.select("doc_id", F.posexplode(X.citations(F.col("text")))).select("doc_id", F.col("pos").cast("long").alias("ord"), F.col("col").alias("citation"))


def unique_citations(found: DataFrame) -> DataFrame:
    """(doc_id, total_found, unique_citations) of documents with any; the first spelling of each stays."""
    normal = found.withColumn("normal", X.normal_citation(F.col("citation")))
    firsts = normal.groupBy("doc_id", F.lower("normal").alias("key")).agg(F.count("*").alias("n"), F.min(F.struct("ord", "normal")).alias("f"))
    return firsts.groupBy("doc_id").agg(F.sum("n").alias("total_found"), F.transform(F.array_sort(F.collect_list("f")), lambda x: x["normal"]).alias("unique_citations"))


def sentences(found: DataFrame) -> DataFrame:
    """(doc_id, section, sid, text) of sections; ids count from 1 in each section. No shuffle."""
    parts = found.select("doc_id", "section", F.posexplode(X.within_limit(X.sentences(F.col("text")))))
    return parts.select("doc_id", "section", (F.col("pos") + 1).cast("long").alias("sid"), F.col("col").alias("text"))


def flattened(found: DataFrame) -> DataFrame:
    """Sentences of the summary's sections with their place (pos, from 0) in the fixed order of sections."""
    at = F.array_position(F.array(*map(F.lit, C.SUMMARY_SECTIONS)), F.col("section"))
    kept = found.withColumn("at", at).where("at > 0")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "sid")) - 1
    return kept.select("doc_id", "section", "sid", pos.cast("long").alias("pos"), "text")
