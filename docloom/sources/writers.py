"""Sinks: JSON documents, reports and summaries as lines for a renderer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    documents.write.mode(mode).json(path)


def write_each(documents: DataFrame, path: str, name: str = "filename", mode: str = "overwrite") -> None:
    """One JSON file a document, in a folder of the document's stem."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    documents.withColumn("stem", stem).repartition("stem").write.mode(mode).partitionBy("stem").json(path)


def evaluation_json(names: list[str]) -> Column:
    """Metrics of a row as one JSON object, by kind: rouge, bertscore, entailment."""
    kinds = {"rouge": "rouge", "bertscore": "bertscore", "entailment": "entailment", "contradiction": "entailment", "neutral": "entailment", "num": "entailment"}
    by: dict[str, list[str]] = {}
    for c in names:
        by.setdefault(next((k for p, k in kinds.items() if c.startswith(p)), "other"), []).append(c)
    return F.to_json(F.struct(*[F.struct(*cs).alias(k) for k, cs in by.items()]))


def numbered(line: Column) -> Column:
    """Is a line of a summary shown as a numbered sentence: digits, a point and an opening bracket."""
    return line.rlike(r"^\d+\.\s*\[")


def summary_lines(summaries: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, bold): a line is a numbered heading if it starts with a digit and has '. [' near its start."""
    lines = summaries.select("doc_id", F.posexplode(F.split("summary", "\n")).alias("line_no", "line"))
    return lines.withColumn("bold", F.substring("line", 1, 1).rlike(r"^\p{Nd}") & F.contains(F.substring("line", 1, 8), F.lit(". [")))


def report(metric_columns: list[str]) -> Column:
    """Metrics of a row as text, four decimals each."""
    return F.concat_ws("\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.format_number(c, 4))) for c in metric_columns])
