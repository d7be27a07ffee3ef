"""python -m docloom: preprocess, chunk, summarize or evaluate files, under spark-submit or alone."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import chunks
from .plans import engine
from .sources import readers, writers


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docloom", description=__doc__)
    job = parser.add_subparsers(dest="job", required=True)
    for name, about in (("preprocess", "JSON documents to processed JSON"), ("chunk", "JSON documents to chunks"), ("summarize", "JSON documents to summaries")):
        own = job.add_parser(name, help=about)
        own.add_argument("source"), own.add_argument("target"), own.add_argument("--pattern", default="*.json")
        if name == "summarize":
            own.add_argument("--level", type=int, default=4, help="4 needs no model")
    own = job.add_parser("evaluate", help="text files of summaries against their sources, by file name")
    own.add_argument("--source", required=True), own.add_argument("--summary", required=True), own.add_argument("--json")
    own.add_argument("--metrics", nargs="+", default=["rouge", "bertscore", "entailment"], choices=["rouge", "bertscore", "entailment"])
    of = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"docloom {of.job}").getOrCreate()
    if of.job == "evaluate":
        named = lambda path, c: readers.texts(spark, path).select(F.regexp_extract("filepath", r"([^/]*)$", 1).alias("doc_id"), F.col("text").alias(c))
        found = engine.evaluate(named(of.source, "source").join(named(of.summary, "summary"), "doc_id"), tuple(of.metrics)).cache()
        found.select("doc_id", writers.report(found.columns[1:]).alias("report")).show(truncate=False)
        if of.json:
            writers.write_json(found.select("doc_id", writers.evaluation_json(found.columns[1:]).alias("metrics")), of.json)
        return
    pages = readers.exploded(readers.json_documents(spark, of.source, of.pattern)).where("error is null").select("doc_id", "page_index", "text")
    if of.job == "summarize":
        writers.write_json(engine.summarize(pages, of.level), of.target)
    else:
        done = engine.preprocess(pages)
        writers.write_json(done if of.job == "preprocess" else chunks.document_chunks(done.withColumnRenamed("doc_id", "filename").withColumn("doc_id", F.col("filename"))), of.target)


if __name__ == "__main__":
    main()
