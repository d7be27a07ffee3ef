"""URL filters: a rule list, and association rules over URL tokens mined by FP-growth for what the list leaves open.

Everything on the main path is a DataFrame expression. The list is a CASE over its rules, longest first. FP-growth's
transactions are labelled URLs: their tokens with the label. Mined rules that end in a verdict are kept from `min_support`
and `min_confidence` on, and without those that a shorter rule of at least the same confidence makes superfluous; the
surest rule that matches decides, and a URL that none matches is allowed. Rules match by an inverted index (token to rules) inside each row: no shuffle, so
a host with a third of all URLs costs nothing extra.

Defined results: a null URL or one without `://` has empty host and path, no list rule and no tokens, and is allowed.
Repeated rows are judged alike. An empty table gives no rows, no labels give no mined rules. Other columns stay as they
are, but for earlier columns named host, path, rule, verdict or matched_by, which the results replace.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rule list of the query: (verdict, host, path).
LIST = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: FP-growth: the share of labelled URLs that have a rule's tokens and verdict, the least number of them, and the share with
#: the verdict of those that have the tokens.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_URLS = 0.002, 0.6, 20


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, rules=LIST) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    none = F.lit(None).cast("string")
    rule = verdict = none
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, segments of the path without digits' values, names of the query."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    some = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    plain = F.regexp_replace(path, r"[0-9]+", "0")
    return F.array_distinct(F.concat(
        some("h:", F.split(host, r"\.")), some("p:", F.split(plain, r"[/._-]")),
        some("q:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
    ))


def mine(labelled: DataFrame, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE, min_urls=MIN_URLS) -> list[tuple[list[str], str, float, float]]:
    """labelled: (tokens, verdict). Rules (tokens, verdict, confidence, support), the surest first, then the best supported.

    All rows are mined: FP-growth's trees hold equal lists of tokens once, so their size follows the distinct lists. Of
    tokens that the same URLs have, one enters, so that tokens that always come together don't multiply the combinations.
    A rule is held by min_support of the URLs and min_urls of them, so tokens_a_url / min_support bounds the tokens that
    are met on the driver."""
    n = labelled.count()
    if not n:
        return []
    least = max(min_urls, math.ceil(min_support * n))
    row = F.xxhash64("tokens").cast("decimal(38,0)")
    frequent = labelled.select(F.explode("tokens").alias("t"), row.alias("row")).groupBy("t").agg(F.count("*").alias("n"), F.sum("row").alias("rows")).where(F.col("n") >= least)
    entering = [r.t for r in frequent.groupBy("n", "rows").agg(F.min("t").alias("t")).collect()]
    if not entering:
        return []
    items = F.array_append(F.filter("tokens", lambda t: t.isin(entering)), F.concat(F.lit("="), "verdict"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=min_confidence).fit(labelled.select(items.alias("items")))
    found = model.associationRules.where(F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    rules = sorted(((sorted(r.antecedent), r.consequent[0][1:], r.confidence, r.support) for r in found.collect()), key=lambda r: (len(r[0]), -r[2], r[0], r[1]))
    shorter: dict[frozenset, tuple[str, float]] = {}
    kept = []
    for r in rules:
        own = frozenset(r[0])
        parts = (shorter.get(frozenset(c)) for k in range(1, len(own)) for c in itertools.combinations(r[0], k))
        if not any(p and p[0] == r[1] and p[1] >= r[2] for p in parts):
            kept.append(r)
            shorter[own] = r[1], r[2]
    return sorted(kept, key=lambda r: (-r[2], -r[3], r[1] != "block", r[0]))


def mined_verdict(found: Column, rules) -> Column:
    """The verdict of the first rule all of whose tokens a URL has; null if there is none. A token's posting list names its
    rules; a rule matches if it is named as often as it has tokens, so only the rules of a URL's own tokens are looked at."""
    if not rules:
        return F.lit(None).cast("string")
    posting: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for t in r[0]:
            posting.setdefault(t, []).append(i)
    index = F.from_json(F.lit(json.dumps(posting)), "map<string,array<int>>")
    size, verdicts = (F.from_json(F.lit(json.dumps(x)), f"array<{kind}>") for x, kind in (([len(r[0]) for r in rules], "int"), ([r[1] for r in rules], "string")))
    hits = F.array_sort(F.flatten(F.filter(F.transform(found, lambda t: F.try_element_at(index, t)), lambda x: x.isNotNull())))
    # sorted, so a rule's last token is where the place as many back as it has tokens names it too
    last = F.transform(F.array(hits), lambda h: F.array_min(F.filter(h, lambda i, at: F.get(h, at - F.get(size, i) + 1) == i)))
    return F.get(verdicts, F.get(last, F.lit(0)))


def judge(pages: DataFrame, labelled: DataFrame, url_col: str = "url", rules=LIST, **mining) -> DataFrame:
    """pages with host, path, rule, verdict and matched_by ('list', 'mined' or 'default') added. labelled: (url, verdict)."""
    url = F.col(url_col)
    host, path = host_path(url)
    rule, verdict = listed(host, path, rules)
    known = labelled.select(tokens(F.col("url"), *host_path(F.col("url"))).alias("tokens"), "verdict").where("verdict is not null and size(tokens) > 0")
    mined = mined_verdict(F.coalesce(tokens(url, host, path), F.array().cast("array<string>")), mine(known, **mining))
    return pages.withColumns({"host": host, "path": path, "rule": rule, "verdict": F.coalesce(verdict, mined, F.lit("allow")), "matched_by": F.when(verdict.isNotNull(), "list").when(mined.isNotNull(), "mined").otherwise("default")})


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, verdict): a page's URL ends in the number of the document that it shows; bad or toxic documents are to block."""
    number = F.regexp_extract(host_path(F.col("url"))[1], r"/([0-9]{1,18})(?:\.html|/)?$", 1).try_cast("long")
    of = labels.select(F.col("doc_id").alias("number"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow").alias("verdict"))
    return pages.select("url", number.alias("number")).join(of, "number").select("url", "verdict")


def op7_url_rules(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(pages, labelled_urls(pages, labels)).select("page_id", "host", "path", "rule", "verdict", "matched_by")
