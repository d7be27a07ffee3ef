"""Sources: page texts from PDFs (by a decoder that the caller plugs in), JSON documents and plain text files.

Files are listed and read by Spark, so any store that Spark reads will do. A file that can't be read gives a row with
`error` set; it never stops the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "filename string, filepath string, page int, page_index int, text string, extraction_method string, ocr_confidence double, error string"
DOCUMENT = "filename string, filepath string, num_pages int, total_characters int, avg_chars_per_page double, extraction_method string, ocr_avg_confidence double, pages array<struct<page:int,text:string,extraction_method:string,ocr_confidence:double>>, _corrupt_record string"

#: decode(bytes of a file) gives (text, method, confidence) of each page.
Decoder = Callable[[bytes], list[tuple[str, str, float | None]]]


def pdf_pages(spark: SparkSession, path: str, decode: Decoder) -> DataFrame:
    """A row for each page of every .pdf or .PDF file below path; files that fail give one row with the error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,PDF}").load(path)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                name = file.rsplit("/", 1)[-1]
                try:
                    rows += [(name, file, i + 1, i, t or "", m, c or None, None) for i, (t, m, c) in enumerate(decode(content))]
                except Exception as e:  # noqa: BLE001 -- whatever the decoder raises becomes the file's error row
                    rows.append((name, file, None, None, None, "failed", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE.split(", ")])

    return files.select("path", "content").mapInPandas(pages, PAGE)


def json_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Documents with their pages, one JSON object a file; broken files have _corrupt_record set."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("pathGlobFilter", pattern).option("mode", "PERMISSIVE").json(path).withColumn("filename", F.coalesce("filename", "_metadata.file_name"))


def exploded(documents: DataFrame) -> DataFrame:
    """(doc_id, page_index, text, ...) of JSON documents; a document without pages has an error row."""
    some = documents.select(F.col("filename").alias("doc_id"), F.posexplode_outer("pages").alias("page_index", "p"))
    return some.select("doc_id", "page_index", F.coalesce("p.text", F.lit("")).alias("text"), "p.extraction_method", "p.ocr_confidence", F.when(F.col("page_index").isNull(), "No pages found").alias("error"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(filepath, text) of plain text files, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("filepath"), F.col("value").alias("text"))


def text_or_pdf(spark: SparkSession, path: str, decode: Decoder) -> DataFrame:
    """(filepath, text, error) of files: the texts of a PDF's pages that have any, by line breaks; other files whole as UTF-8.
    A PDF without text, or that can't be read, has a null text and the error."""
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(r"(?i)\.pdf$"))
    pages = pdf_pages(spark, path, decode).groupBy("filepath").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("page", "text")))), lambda x: x["text"]), "\n").alias("text"), F.max("error").alias("error"))
    found = pages.select("filepath", F.nullif("text", F.lit("")).alias("text"), F.when(F.col("text") == "", F.coalesce("error", F.lit("no text in this PDF"))).alias("error"))
    return found.unionByName(plain.select(F.col("path").alias("filepath"), F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("string").alias("error")))


def document_stats(pages: DataFrame) -> DataFrame:
    """Documents of page rows as the JSON sink writes them: pages in order, counts, the first page's method, mean confidence."""
    good = pages.where("error is null").groupBy("filename", "filepath").agg(
        F.count("*").cast("int").alias("num_pages"), F.sum(F.length("text")).cast("int").alias("total_characters"), F.avg(F.length("text")).alias("avg_chars_per_page"),
        F.min_by("extraction_method", "page").alias("extraction_method"), F.avg(F.nullif("ocr_confidence", F.lit(0.0))).alias("ocr_avg_confidence"),
        F.array_sort(F.collect_list(F.struct("page", "text", "extraction_method", "ocr_confidence"))).alias("pages"),
    )
    return good.withColumn("ocr_avg_confidence", F.when(F.col("extraction_method") == "ocr", F.col("ocr_avg_confidence")))
