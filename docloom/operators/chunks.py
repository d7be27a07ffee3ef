"""Chunking: paragraphs packed to a word budget, long ones cut by sentences. A fold over one document, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C

SCHEMA = "index long, text string, word_count long, char_start long, char_end long, section string"
_count = lambda text: len(text.split())


def packed_paragraphs(text: str, most: int = C.CHUNK_MAX) -> list[str]:
    """Neighbouring paragraphs together while they have `most` words at most."""
    out: list[list[str]] = []
    size = 0
    for p in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        n = _count(p)
        if out and size + n <= most:
            out[-1].append(p)
            size += n
        else:
            out.append([p])
            size = n
    return ["\n\n".join(p) for p in out]


def chunk(text: str, most: int = C.CHUNK_MAX, target: int = C.CHUNK_TARGET, least: int = C.CHUNK_MIN, overlap: int = C.CHUNK_OVERLAP) -> list[tuple]:
    """(index, text, words, start, end, section) of each chunk; places are those of the chunks laid end to end."""
    text = text.strip()
    out: list[tuple] = []
    if not text:
        return out
    if _count(text) <= most:
        return [(0, text, _count(text), 0, len(text), _section(text))]
    at = 0

    def emit(parts: list[str], by: str, gap: int) -> None:
        nonlocal at
        whole = by.join(parts)
        out.append((len(out), whole, _count(whole), at, at + len(whole), _section(whole)))
        at += len(whole) + gap

    def by_sentence(paragraph: str) -> None:
        nonlocal at
        held, words = [], 0
        for s in filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", paragraph))):
            if words + _count(s) > target and words >= least:
                emit(held, " ", 1)
                held = held[-1:]
                words = _count(held[0])
            held.append(s)
            words += _count(s)
        if held:
            emit(held, " ", 2)

    held, words = [], 0
    for p in packed_paragraphs(text, most):
        n = _count(p)
        if n > most:
            if held:
                emit(held, "\n\n", 2)
            by_sentence(p)
            held, words = [], 0
            continue
        if words + n > target and words >= least:
            emit(held, "\n\n", 2)
            tail, room = [], overlap
            while held and _count(held[-1]) <= room:
                room -= _count(held[-1])
                tail.insert(0, held.pop())
            held, words = tail, overlap - room
        held.append(p)
        words += n
    if held:
        emit(held, "\n\n", 2)
    return out


def _section(text: str) -> str | None:
    found = re.search(r"\[([A-Z]+)\]", text)
    return found[1] if found else None


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, index, text, word_count, char_start, char_end, section): the chunks of every document; a null or blank text has none."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = [(k, *c) for k, t in enumerate(part.column(1).to_pylist()) for c in chunk(t or "")]
                k, *columns = zip(*rows) if rows else [()] * 7
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], [id_col, "index", "text", "word_count", "char_start", "char_end", "section"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(fold, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def document_chunks(processed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks of processed documents: of the summary's text, else the text, else the sections' texts in their order, as far
    as the columns summary_text, text and sections are there. source_file is the file name, or `unknown`."""
    texts = [F.col(c) for c in ("summary_text", "text") if c in processed.columns]
    if "sections" in processed.columns:
        texts.append(F.array_join(F.transform(F.array_sort("sections"), lambda x: x["text"]), "\n\n"))
    name = F.coalesce("filename", F.lit("unknown")) if "filename" in processed.columns else F.lit("unknown")
    made = chunks(processed.select(F.struct(F.col(id_col).alias("id"), name.alias("file")).alias("__key"), F.coalesce(*texts).alias("__text")), "__key", "__text")
    return made.select(F.col("__key.id").alias(id_col), *[c for c in made.columns if c != "__key"], F.col("__key.file").alias("source_file"))
