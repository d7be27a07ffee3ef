"""Text functions as Column expressions: no Python on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x)).cast("long")


def without_header(text: Column, header: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda line: strip(line) != strip(header))
    return F.when(F.coalesce(header, F.lit("")) == "", text).otherwise(F.array_join(kept, "\n"))


def without_footers(text: Column) -> Column:
    for p in C.FOOTER_PATTERNS:
        text = F.regexp_replace(text, f"(?mid){p}", "")
    return text


def without_page_numbers(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~strip(line).rlike(r"^\p{Nd}{1,3}$")), "\n")


def normal_space(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, "\r", ""), "[ \t]+", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def clean(text: Column, header: Column) -> Column:
    return normal_space(without_page_numbers(without_footers(without_header(text, header))))


def page_type(text: Column, index: Column) -> Column:
    low = F.lower(text)
    metadata = sum((F.contains(low, F.lit(m.lower())).cast("int") for m in C.METADATA_MARKERS), F.lit(0))
    out = F.when((index < 3) & (metadata >= 2), "metadata")
    for name, markers in C.SECTION_MARKERS.items():
        some = F.lit(False)
        for m in dict.fromkeys(x.lower() for x in markers):
            some = some | F.contains(low, F.lit(m))
        out = out.when(some, name)
    return out.otherwise("unknown")


def normal_citation(x: Column) -> Column:
    x = F.array_join(words(x), " ")
    x = F.regexp_replace(x, r"(?U)\s*\(\s*", " (")
    return strip(F.regexp_replace(x, r"(?U)\s*\)\s*", ") "))


def citations(text: Column) -> Column:
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), g) for p, g in C.CITATION_PATTERNS])


#: What may begin a sentence; a word that is an abbreviation and its end (Java looks behind a bounded length alone).
_BEGIN = r"""(?=[A-Z0-9\(\["])"""
_ABBREVIATION = r"(?<!\S)(?i:" + "|".join(re.escape(x) for x in sorted(C.ABBREVIATIONS, key=len, reverse=True)) + ")"


def sentences(text: Column) -> Column:
    """Sentences of more than 5 characters. A part that ends in an abbreviation runs on into the next, after one space."""
    text = F.regexp_replace(strip(text), rf"(?U)({_ABBREVIATION}[.!?]++)\s+{_BEGIN}", "$1 ")
    parts = F.split(text, rf"(?U)(?<=[.!?])\s+{_BEGIN}(?<!{_ABBREVIATION}[.!?]{{1,40}}\s{{1,1}})")
    return F.filter(parts, lambda s: F.length(s) > 5)


def within_limit(parts: Column) -> Column:
    """Sentences of more than WORD_LIMIT words become windows of WINDOW_WORDS that overlap."""
    step = C.WINDOW_WORDS - C.WINDOW_OVERLAP

    def windows(s: Column) -> Column:
        w = words(s)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i + C.WINDOW_OVERLAP < F.size(w)))
        return F.when(F.size(w) > C.WORD_LIMIT, F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(C.WINDOW_WORDS)), " "))).otherwise(F.array(s))

    return F.flatten(F.transform(parts, windows))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda p: p != "")


def evaluation_sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), r"(?U)(?<=[.?!])\s+(?=[A-Z])"), lambda s: F.length(s) > 10)


def truncated(text: Column, n: int = 400) -> Column:
    w = words(text)
    return F.when(F.size(w) <= n, text).otherwise(F.array_join(F.slice(w, 1, n), " "))


def blocks(text: Column, n: int = 300) -> Column:
    w = words(text)
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(n))
    return F.when(F.size(w) <= n, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))


def unmarked(text: Column) -> Column:
    names = "|".join(x.upper() for x in ["headnote", "facts", "issues", "arguments", "reasoning", "order", "dissent"])
    return strip(F.regexp_replace(F.regexp_replace(text, rf"\[({names})\]\n?", ""), "\n{3,}", "\n\n"))


def section_marker(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\[([A-Z]+)\]", 1), F.lit(""))


def decode_cleanup(text: Column) -> Column:
    for p in (r"\[{2,}[^\]]*\]{0,}", r"\]{2,}", r"\[\d+[A-Za-z]*\]"):
        text = F.regexp_replace(text, p, "")
    parts = F.split(strip(text), r"(?U)(?<=[.!?])\s+")
    last = F.element_at(parts, -1)
    letters = F.length(F.regexp_replace(last, r"\P{L}", ""))
    noise = (F.size(parts) > 1) & (F.length(last) > 20) & (letters / F.length(last) < 0.5)
    text = F.when(noise, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")).otherwise(text)
    return strip(F.regexp_replace(text, r"(?U)\s{2,}", " "))


def metadata_prefix(header: Column, metadata: Column, cited: Column) -> Column:
    header, metadata = strip(F.coalesce(header, F.lit(""))), strip(F.coalesce(metadata, F.lit("")))
    line = F.substring(strip(F.split(metadata, "\n")[0]), 1, 100)
    acts = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(cited, F.array().cast("array<string>")), strip), lambda x: x != "")), 1, 10)
    out = F.concat_ws(
        " ", F.when(header != "", F.concat(F.lit("[CASE: "), F.substring(header, 1, 120), F.lit("]"))),
        F.when(line != "", F.concat(F.lit("[COURT: "), line, F.lit("]"))),
        F.when(F.size(acts) > 0, F.concat(F.lit("[ACTS: "), F.array_join(acts, "; "), F.lit("]"))),
    )
    return F.when(out != "", F.concat(out, F.lit(" "))).otherwise("")


def grounded(summary: Column, allowed: Column, sections: Column) -> Column:
    """A summary's sentences without those that drift from `allowed` (text) or cite other than `sections` (array)."""
    text, low = decode_cleanup(summary), F.lower(F.coalesce(allowed, F.lit("")))
    near = F.transform(F.coalesce(sections, F.array().cast("array<string>")), F.lower)

    def drifts(s: Column) -> Column:
        out = F.lit(False)
        for p in C.DRIFT_PATTERNS:
            found = F.lower(F.regexp_extract(s, f"(?i)({p})", 1))
            out = out | ((found != "") & ~F.contains(low, found))
        mentions = F.regexp_extract_all(s, F.lit(C.SECTION_MENTION), 0)
        return out | ((F.size(near) > 0) & F.exists(mentions, lambda m: ~F.exists(near, lambda a: F.contains(a, F.lower(m)))))

    kept = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: (s != "") & ~drifts(s))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)
