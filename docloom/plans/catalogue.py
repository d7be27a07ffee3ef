"""The queries, each with equivalent SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X
from ..operators import chunks as chunking
from ..operators import metrics, pages, vectors
from ..sources import ocr
from . import engine, models

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs: tables with what the operators look for added in fixed places, the same in both dialects --------------------
MARKED = """SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS BIGINT) AS page_index,
  (CASE WHEN conv_id % 3 = 0 THEN 'State of Testland versus Example Party' || chr(10) ELSE '' END)
  || (CASE (conv_id + turn) % 9 WHEN 0 THEN 'HEADNOTE Held that. ' WHEN 1 THEN 'FACTS OF THE CASE. ' WHEN 2 THEN 'The question is this. '
      WHEN 3 THEN 'Learned counsel spoke. ' WHEN 4 THEN 'We have heard all. ' WHEN 5 THEN 'I am unable to agree. ' WHEN 6 THEN 'Appeal dismissed. ' ELSE '' END)
  || text || ' See Section ' || CAST(conv_id % 40 + 1 AS STRING) || '(' || CAST(turn % 3 + 1 AS STRING) || ') of the Indian Penal Act, 1860 and '
  || CAST(1950 + turn AS STRING) || ' AIR ' || CAST(conv_id + 1 AS STRING) || '.'
  || chr(10) || 'Indian Kanoon - http://indiankanoon.org/doc/' || CAST(1000 + conv_id AS STRING) || '/ ' || CAST(turn + 1 AS STRING)
  || chr(10) || CAST(turn + 1 AS STRING) AS text FROM conversations"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row a page; ids of conversations and turns are a key
    return spark.sql(MARKED.replace("FROM conversations", "FROM {c}"), c=table(spark, sf_dir, "conversations"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: the label is the document, the id the place; with near copies of every tenth."""
    v = table(spark, sf_dir, "embeddings")
    copies = v.where("vec_id % 10 = 0").select((F.col("vec_id") + 10_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i == 0, x + F.lit(0.05).cast("float")).otherwise(x)).alias("embedding"), "label")
    return v.select("vec_id", "embedding", "label").union(copies).select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("pos"), F.element_at(F.array(F.lit("order"), F.lit("Reasoning"), F.lit("facts"), F.lit("other")), (F.col("vec_id") % 4 + 1).cast("int")).alias("section"), "embedding")


def intents(spark: SparkSession, sf_dir: str) -> list[tuple[str, list[float]]]:
    """Eight vectors stand for the questions: those with ids 0 to 7."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id < 8").orderBy("vec_id").collect()
    return [(f"intent{r.vec_id}", [float(x) for x in r.embedding]) for r in rows]


# SQL fragments -----------------------------------------------------------------------------------------------------
q = lambda s: "'" + s.replace("'", "''") + "'"
strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
words = lambda x: rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"
lines = lambda x, keep: f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: {keep}), chr(10))"
footers = lambda x: rf"regexp_replace(regexp_replace({x}, {q('(?im)' + C.FOOTER_PATTERNS[0])}, '', 'g'), {q('(?im)' + C.FOOTER_PATTERNS[1])}, '', 'g')"
numbers = lambda x: lines(x, rf"NOT regexp_matches({strip('l')}, '^[0-9]{{1,3}}$')")
spaces = lambda x: strip(rf"regexp_replace(regexp_replace(replace({x}, chr(13), ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
split_after = lambda x, ends, nxt: rf"string_split(regexp_replace({x}, '([{ends}])\s+([{nxt}])', '\1' || chr(1) || '\2', 'g'), chr(1))"
_last = r"lower(regexp_replace(regexp_extract(p, '(\S+)\s*$', 1), '[.!?]+$', ''))"
_abbreviations = ", ".join(map(q, C.ABBREVIATIONS))
sentences = lambda x: rf"list_filter(list_transform(string_split(array_to_string(list_transform({split_after(x, '.!?', 'A-Z0-9(\\[\"')}, lambda p: p || CASE WHEN {_last} IN ({_abbreviations}) THEN ' ' ELSE chr(2) END), ''), chr(2)), lambda s: {strip('s')}), lambda s: len(s) > 5)"
limited = lambda x: rf"flatten(list_transform({x}, lambda s: CASE WHEN len({words('s')}) > 393 THEN list_transform(list_filter(range(0, len({words('s')}), 350), lambda i: i = 0 OR i + 50 < len({words('s')})), lambda i: array_to_string(({words('s')})[i + 1 : i + 400], ' ')) ELSE [s] END))"
_type = f"CASE WHEN page_index < 3 AND ({' + '.join(f'CAST(contains(lower(text), {q(m.lower())}) AS INT)' for m in C.METADATA_MARKERS)}) >= 2 THEN 'metadata' " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {q(m.lower())})' for m in ms)} THEN '{t}'" for t, ms in C.SECTION_MARKERS.items()) + " ELSE 'unknown' END"
HEADER = rf"""header AS (SELECT doc_id, CASE WHEN pages >= 2 AND n >= pages // 2 AND len(line) > 20 THEN line END AS header FROM (
  SELECT *, sum(n) OVER (PARTITION BY doc_id) AS pages, row_number() OVER (PARTITION BY doc_id ORDER BY line IS NULL, n DESC, seen) AS r FROM (
    SELECT doc_id, line, count(*) AS n, min(page_index) AS seen FROM (SELECT doc_id, page_index, CASE WHEN {strip('text')} <> '' THEN {strip(f"string_split({strip('text')}, chr(10))[1]")} END AS line FROM marked) GROUP BY ALL)) WHERE r = 1)"""
_headed = f"CASE WHEN coalesce(header, '') = '' THEN text ELSE {lines('text', f'{strip('l')} <> {strip('header')}')} END"
CLEANED = f"WITH marked AS ({MARKED}), {HEADER}, cleaned AS (SELECT doc_id, page_index, header, {spaces(numbers(footers(_headed)))} AS text FROM marked JOIN header USING (doc_id))"
TYPED = f"{CLEANED}, typed AS (SELECT *, {_type} AS page_type FROM cleaned)"
SECTIONS = rf"""{TYPED}, runs AS (SELECT * FROM (SELECT *, page_type NOT IN ('unknown', 'metadata') AS start, sum(CAST(page_type NOT IN ('unknown', 'metadata') AS INT)) OVER (PARTITION BY doc_id ORDER BY page_index) AS run FROM typed) WHERE run > 0),
 closed AS (SELECT doc_id, run, max(CASE WHEN start THEN page_type END) AS section, string_agg(text, chr(10) ORDER BY page_index) AS text, min(page_index) AS f, max(page_index) AS l FROM runs GROUP BY ALL),
 ends AS (SELECT *, coalesce(lead(f) OVER (PARTITION BY doc_id ORDER BY run), l) AS closes FROM closed),
 named AS (SELECT doc_id, section, min(run) AS first_run, string_agg(text, chr(10) || chr(10) ORDER BY run) AS text, list(closes ORDER BY run) AS page_range FROM ends GROUP BY ALL),
 sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_run) AS ord, section, {spaces('text')} AS text, page_range FROM named)"""
_at = "list_position([" + ", ".join(map(q, C.SUMMARY_SECTIONS)) + "], section)"
SUMMARY = f"{SECTIONS}, summary AS (SELECT doc_id, string_agg('[' || upper(section) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY {_at}) AS text FROM sections WHERE {_at} > 0 AND text <> '' GROUP BY doc_id)"
_cited = "list_concat(" * (len(C.CITATION_PATTERNS) - 1) + f"regexp_extract_all(text, {q(C.CITATION_PATTERNS[0][0])}, 1)" + "".join(f", regexp_extract_all(text, {q(p)}, {g}))" for p, g in C.CITATION_PATTERNS[1:])
CITED = f"{TYPED}, whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page_index) AS text FROM typed GROUP BY doc_id), lists AS (SELECT doc_id, {_cited} AS c FROM whole), cited AS (SELECT doc_id, unnest(range(len(c))) AS ord, unnest(c) AS citation FROM lists)"
_normal = rf"trim(regexp_replace(regexp_replace(array_to_string({words('citation')}, ' '), '\s*\(\s*', ' (', 'g'), '\s*\)\s*', ') ', 'g'))"
UNIQUE = f"{CITED}, firsts AS (SELECT doc_id, lower({_normal}) AS k, count(*) AS n, min(ord) AS o, min_by({_normal}, ord) AS normal FROM cited GROUP BY ALL), uniq AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_found, list(normal ORDER BY o) AS unique_citations FROM firsts GROUP BY doc_id)"
SENTENCES = f"{SECTIONS}, sentence_lists AS (SELECT doc_id, section, {limited(sentences('text'))} AS s FROM sections), sents AS (SELECT doc_id, section, unnest(range(1, len(s) + 1)) AS sid, unnest(s) AS text FROM sentence_lists)"
each = lambda x, start=0: f"SELECT doc_id, unnest(range({start}, len(s) + {start})) AS pos, unnest(s) AS part FROM (SELECT doc_id, {x} AS s FROM documents)"
_dup = "SELECT CAST(label AS BIGINT) AS doc_id, vec_id AS pos, ['order', 'Reasoning', 'facts', 'other'][vec_id % 4 + 1] AS section, CAST(embedding AS DOUBLE[]) AS e FROM (SELECT vec_id, embedding, label FROM embeddings UNION ALL SELECT vec_id + 10000000, list_transform(embedding, lambda x, i: CASE WHEN i = 1 THEN CAST(x + CAST(0.05 AS FLOAT) AS FLOAT) ELSE x END), label FROM embeddings WHERE vec_id % 10 = 0)"
_cos = lambda a, b: f"list_inner_product({a}, {b}) / ((sqrt(list_inner_product({a}, {a})) + 1e-9) * (sqrt(list_inner_product({b}, {b})) + 1e-9))"
_boost = "CASE " + " ".join(f"WHEN contains(lower(section), '{n}') THEN {v}" for n, v in C.SECTION_BOOSTS) + " ELSE 0 END"
VECTORS = f"""WITH chunks AS ({_dup}), dims AS (SELECT doc_id, i, avg(e[i]) AS x FROM chunks, range(1, 65) AS t(i) GROUP BY ALL), centroids AS (SELECT doc_id, list(x ORDER BY i) AS c FROM dims GROUP BY doc_id),
 intents AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 8), sims AS (SELECT doc_id, pos, section, k, {_cos('e', 'v')} AS s FROM chunks, intents),
 comp AS (SELECT doc_id, pos, avg(s) AS composite FROM sims GROUP BY ALL),
 scored AS (SELECT doc_id, pos, e, section, {_cos('e', 'c')} AS global_score, composite, 0.4 * ({_cos('e', 'c')}) + 0.6 * composite + {_boost} AS score FROM chunks JOIN centroids USING (doc_id) JOIN comp USING (doc_id, pos))"""
TOP_N = 12
_topk = "SELECT doc_id, 'intent' || CAST(k AS VARCHAR) AS intent, rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY s DESC, pos) AS rank FROM sims) WHERE rank <= 3"
CANDIDATES = f"""{VECTORS}, cand AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos DESC) AS r FROM scored) WHERE r <= {2 * TOP_N}
 UNION SELECT doc_id, pos FROM ({_topk}) UNION SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS r FROM scored) WHERE r <= 3)"""


# Pages ---------------------------------------------------------------------------------------------------------------
@query(f"WITH marked AS ({MARKED}) SELECT doc_id, count(*) AS num_pages, CAST(sum(len(text)) AS BIGINT) AS total_characters, round(avg(len(text)), 6) AS avg_chars_per_page FROM marked GROUP BY doc_id")
def doc_stats(spark, d):
    return pages.doc_stats(marked(spark, d)).withColumn("avg_chars_per_page", F.round("avg_chars_per_page", 6))


@query(f"WITH marked AS ({MARKED}) SELECT doc_id, avg(len({strip('text')})) > 100 AS is_text_based FROM marked WHERE page_index < 3 GROUP BY doc_id")
def text_based_flag(spark, d):
    return pages.text_based(marked(spark, d))


@query("SELECT CAST(conv_id AS BIGINT) AS doc_id, round(avg(CASE WHEN turn <> 0 THEN turn * 10.0 END), 6) AS ocr_avg_confidence FROM conversations GROUP BY conv_id")
def ocr_conf_avg(spark, d):
    read = marked(spark, d).withColumns({"extraction_method": F.lit("ocr"), "ocr_confidence": F.col("page_index") * 10.0})
    return pages.ocr_confidence(read).withColumn("ocr_avg_confidence", F.round("ocr_avg_confidence", 6))


@query(f"WITH marked AS ({MARKED}), {HEADER} SELECT doc_id, header FROM header")
def repeated_header(spark, d):
    return pages.repeated_header(marked(spark, d))


@query(f"WITH marked AS ({MARKED}) SELECT doc_id, page_index, {lines('text', f'{strip('l')} <> {q('State of Testland versus Example Party')}')} AS text FROM marked")
def remove_headers(spark, d):
    return marked(spark, d).withColumn("text", X.without_header(F.col("text"), F.lit("State of Testland versus Example Party")))


@query(f"WITH marked AS ({MARKED}) SELECT doc_id, page_index, {footers('text')} AS text FROM marked")
def remove_footers(spark, d):
    return marked(spark, d).withColumn("text", X.without_footers(F.col("text")))


@query(f"WITH marked AS ({MARKED}) SELECT doc_id, page_index, {numbers('text')} AS text FROM marked")
def remove_page_numbers(spark, d):
    return marked(spark, d).withColumn("text", X.without_page_numbers(F.col("text")))


@query(f"SELECT doc_id, {spaces('replace(text, chr(10), chr(10) || chr(10) || chr(13) || chr(10) || chr(10))')} AS text FROM documents")
def normalize_ws(spark, d):
    return documents(spark, d).select("doc_id", X.normal_space(F.replace("text", F.lit("\n"), F.lit("\n\n\r\n\n"))).alias("text"))


@query(f"{CLEANED} SELECT doc_id, page_index, text FROM cleaned")
def clean_pages(spark, d):
    return pages.cleaned(marked(spark, d)).select("doc_id", "page_index", "text")


@query(f"{TYPED} SELECT doc_id, page_index, page_type FROM typed")
def classify_pages(spark, d):
    return pages.classified(marked(spark, d)).select("doc_id", "page_index", "page_type")


@query(f"{TYPED} SELECT doc_id, " + ", ".join(f"CAST(count(*) FILTER (page_type = '{t}') AS BIGINT) AS \"{t}\"" for t in C.PAGE_TYPES) + " FROM typed GROUP BY doc_id")
def page_histogram(spark, d):
    return pages.histogram(pages.classified(marked(spark, d)))


@query(f"{SECTIONS} SELECT doc_id, ord, section, text FROM sections")
def merge_sections(spark, d):
    return pages.sections(pages.classified(marked(spark, d))).drop("page_range")


@query(f"{SECTIONS} SELECT doc_id, section, array_to_string(page_range, ',') AS page_range FROM sections")
def page_ranges(spark, d):
    return pages.sections(pages.classified(marked(spark, d))).select("doc_id", "section", F.array_join("page_range", ",").alias("page_range"))


@query(f"{SUMMARY} SELECT doc_id, text FROM summary")
def summarization_text(spark, d):
    return pages.summary_text(pages.sections(pages.classified(marked(spark, d))))


@query(rf"{SUMMARY} SELECT doc_id, {strip(r"regexp_replace(regexp_replace(text, '\[(HEADNOTE|FACTS|ISSUES|ARGUMENTS|REASONING|ORDER|DISSENT)\]\n?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM summary")
def clean_text(spark, d):
    return summarization_text(spark, d).select("doc_id", X.unmarked(F.col("text")).alias("text"))


@query(rf"{SUMMARY} SELECT doc_id, nullif(regexp_extract(text, '\[([A-Z]+)\]', 1), '') AS section FROM summary")
def section_markers(spark, d):
    return summarization_text(spark, d).select("doc_id", X.section_marker(F.col("text")).alias("section"))


@query(f"{TYPED} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_index) AS metadata_text FROM typed WHERE page_type = 'metadata' GROUP BY doc_id")
def metadata_text(spark, d):
    return pages.metadata_text(pages.classified(marked(spark, d)))


@query(f"{CITED} SELECT doc_id, ord, citation FROM cited")
def citations_all(spark, d):
    return pages.citations(pages.classified(marked(spark, d)))


@query(f"{CITED} SELECT doc_id, ord, {_normal} AS citation FROM cited")
def normalize_citations(spark, d):
    return citations_all(spark, d).withColumn("citation", X.normal_citation(F.col("citation")))


@query(f"{UNIQUE} SELECT doc_id, total_found, array_to_string(unique_citations, '; ') AS unique_citations FROM uniq")
def citations_unique(spark, d):
    return pages.unique_citations(citations_all(spark, d)).withColumn("unique_citations", F.array_join("unique_citations", "; "))


# Sentences and chunks ------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, CAST(len({words('text')}) AS BIGINT) AS n_words FROM documents")
def word_counts(spark, d):
    return documents(spark, d).select("doc_id", X.word_count(F.col("text")).alias("n_words"))


@query(each(sentences("text"), 1))
def segment_sentences(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text")))).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("col").alias("part"))


@query(each(limited(f"[{strip('text')}]"), 1))
def sentence_windows(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(X.within_limit(F.array(X.strip(F.col("text")))))).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("col").alias("part"))


@query(f"{SENTENCES} SELECT doc_id, section, sid, text FROM sents")
def section_sentences(spark, d):
    return pages.sentences(pages.sections(pages.classified(marked(spark, d))))


@query(f"{SENTENCES} SELECT doc_id, section, sid, row_number() OVER (PARTITION BY doc_id ORDER BY {_at}, sid) - 1 AS pos, text FROM sents WHERE {_at} > 0")
def flatten_sentences(spark, d):
    return pages.flattened(section_sentences(spark, d))


@query(f"{SUMMARY}, counted AS (SELECT doc_id, CAST(len({words('text')}) AS BIGINT) AS word_count FROM summary) SELECT * FROM counted")
def summary_word_count(spark, d):
    return summarization_text(spark, d).select("doc_id", X.word_count(F.col("text")).alias("word_count"))


@query(each(rf"list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: {strip('p')}), lambda p: p <> '')"))
def paragraphs(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(X.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))))).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("part"))


@query(each(f"CASE WHEN len({words('text')}) <= 300 THEN [text] ELSE list_transform(range(0, len({words('text')}), 300), lambda i: array_to_string(({words('text')})[i + 1 : i + 300], ' ')) END"))
def word_blocks(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(X.blocks(F.col("text")))).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("part"))


@query(each(f"list_filter(list_transform({split_after('text', '.?!', 'A-Z')}, lambda s: {strip('s')}), lambda s: len(s) > 10)"))
def eval_sentences(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(X.evaluation_sentences(F.col("text")))).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("part"))


@query(f"SELECT doc_id, CASE WHEN len({words('text')}) <= 400 THEN text ELSE array_to_string(({words('text')})[1:400], ' ') END AS text FROM documents")
def truncate_words(spark, d):
    return documents(spark, d).select("doc_id", X.truncated(F.col("text")).alias("text"))


@query()
def chunks(spark, d):
    return chunking.chunks(documents(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


# Vectors -------------------------------------------------------------------------------------------------------------
@query(f"{VECTORS} SELECT doc_id, i - 1 AS dim, round(x, 6) AS x FROM dims")
def centroid(spark, d):
    return vectors.centroid(chunk_vectors(spark, d)).select("doc_id", F.posexplode("centroid").alias("dim", "x")).select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def _scored(spark, d):
    return vectors.scored(chunk_vectors(spark, d), intents(spark, d))


@query(f"{VECTORS} SELECT doc_id, pos, round(global_score, 6) AS global_score FROM scored")
def global_relevance(spark, d):
    return _scored(spark, d).select("doc_id", "pos", F.round("global_score", 6).alias("global_score"))


@query(f"{VECTORS} SELECT doc_id, pos, round(composite, 6) AS composite FROM scored")
def intent_composite(spark, d):
    return _scored(spark, d).select("doc_id", "pos", F.round("composite", 6).alias("composite"))


@query(f"{VECTORS} SELECT doc_id, pos, round(score, 6) AS score FROM scored")
def hybrid_score(spark, d):
    return _scored(spark, d).select("doc_id", "pos", F.round("score", 6).alias("score"))


@query(f"{VECTORS} {_topk}")
def intent_topk(spark, d):
    return vectors.intent_topk(_scored(spark, d), intents(spark, d), 3)


@query(f"{CANDIDATES} SELECT doc_id, pos FROM cand")
def candidates(spark, d):
    return vectors.candidates(_scored(spark, d), intents(spark, d), TOP_N)


@query(f"""WITH RECURSIVE {CANDIDATES[5:]}, ranked AS (SELECT doc_id, pos, e, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM scored JOIN cand USING (doc_id, pos)),
 walk AS (SELECT doc_id, CAST(1 AS BIGINT) AS r, [pos] AS ids, [e] AS vs FROM ranked WHERE r = 1 UNION ALL
  SELECT w.doc_id, n.r, CASE WHEN ok THEN list_append(ids, pos) ELSE ids END, CASE WHEN ok THEN list_append(vs, e) ELSE vs END FROM (SELECT w.*, n.pos, n.e, n.r AS nr, len(w.ids) < {TOP_N} AND list_max(list_transform(w.vs, lambda v: {_cos('v', 'n.e')})) <= 0.95 AS ok FROM walk w JOIN ranked n ON n.doc_id = w.doc_id AND n.r = w.r + 1) w JOIN (SELECT doc_id, r FROM ranked) n ON n.doc_id = w.doc_id AND n.r = w.nr),
 final AS (SELECT doc_id, arg_max(ids, r) AS ids FROM walk GROUP BY doc_id) SELECT doc_id, unnest(ids) AS pos FROM final""")
def diverse_select(spark, d):
    return vectors.select(chunk_vectors(spark, d), intents(spark, d), TOP_N).select("doc_id", "pos")


_chosen = f"({ORACLE_SQL['diverse_select']})"


@query(f"""SELECT doc_id, total, selected, total_words, selected_words, round(selected / total, 6) AS ratio, round(coalesce(selected_words / nullif(total_words, 0), 0), 6) AS word_coverage FROM (
 SELECT c.doc_id, count(*) AS total, count(d.pos) AS selected, CAST(sum(c.pos % 50) AS BIGINT) AS total_words, CAST(coalesce(sum(CASE WHEN d.pos IS NOT NULL THEN c.pos % 50 END), 0) AS BIGINT) AS selected_words
 FROM ({_dup}) c LEFT JOIN {_chosen} d ON c.doc_id = d.doc_id AND c.pos = d.pos GROUP BY c.doc_id)""")
def selection_stats(spark, d):
    rows = chunk_vectors(spark, d).withColumn("words", F.col("pos") % 50)
    return vectors.selection_stats(rows, diverse_select(spark, d)).withColumns({c: F.round(c, 6) for c in ("ratio", "word_coverage")})


@query(f"SELECT c.doc_id, c.section, count(*) AS n FROM ({_dup}) c JOIN {_chosen} d ON c.doc_id = d.doc_id AND c.pos = d.pos GROUP BY ALL")
def section_distribution(spark, d):
    return vectors.section_distribution(chunk_vectors(spark, d), diverse_select(spark, d))


# Summaries -----------------------------------------------------------------------------------------------------------
@query()
def extractive_summary(spark, d):
    return engine.summarize(marked(spark, d))


PROCESSED = f"{SUMMARY}{SENTENCES[len(SECTIONS):]}{UNIQUE[len(TYPED):]}"


@query(f"""{PROCESSED} SELECT t.doc_id, t.total_pages, CAST(coalesce(len({words('s.text')}), 0) AS BIGINT) AS summary_words, coalesce(n.n, 0) AS total_sentences, t.header AS repeated_header, coalesce(u.total_found, 0) AS total_found, coalesce(array_to_string(u.unique_citations, '; '), '') AS unique_citations
 FROM (SELECT doc_id, count(*) AS total_pages, max(header) AS header FROM typed GROUP BY doc_id) t LEFT JOIN summary s USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id) n USING (doc_id) LEFT JOIN uniq u USING (doc_id)""")
def processed_documents(spark, d):
    return engine.preprocess(marked(spark, d)).select("doc_id", "total_pages", "summary_words", "total_sentences", "repeated_header", "total_found", F.array_join("unique_citations", "; ").alias("unique_citations"))


@query(rf"""{UNIQUE}, meta AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_index) AS m FROM typed WHERE page_type = 'metadata' GROUP BY doc_id)
 SELECT doc_id, CASE WHEN concat_ws(' ', a, b, c) = '' THEN '' ELSE concat_ws(' ', a, b, c) || ' ' END AS prefix FROM (SELECT h.doc_id, CASE WHEN coalesce(header, '') <> '' THEN '[CASE: ' || left(header, 120) || ']' END AS a,
  CASE WHEN left({strip(f"string_split({strip('m')}, chr(10))[1]")}, 100) <> '' THEN '[COURT: ' || left({strip(f"string_split({strip('m')}, chr(10))[1]")}, 100) || ']' END AS b,
  CASE WHEN len(unique_citations) > 0 THEN '[ACTS: ' || array_to_string(unique_citations[1:10], '; ') || ']' END AS c FROM header h LEFT JOIN meta USING (doc_id) LEFT JOIN uniq USING (doc_id))""")
def metadata_prefix(spark, d):
    done = engine.preprocess(marked(spark, d))
    return done.select("doc_id", X.metadata_prefix(F.col("repeated_header"), F.col("metadata_text"), F.col("unique_citations")).alias("prefix"))


NOISY = "text || CASE WHEN doc_id % 2 = 0 THEN ' [[1] junk] end. [2B] %%%% #### 1234 5678 9999 $$$$' ELSE ' ]] The  Bombay High Court ruled. Section 99 applies. New York.' END"
_tidy = r"regexp_replace(regexp_replace(regexp_replace(text, '\[{2,}[^\]]*\]{0,}', '', 'g'), '\]{2,}', '', 'g'), '\[\d+[A-Za-z]*\]', '', 'g')"
_ends = lambda x: rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
TIDY = rf"""WITH noisy AS (SELECT doc_id, {NOISY} AS text FROM documents), tidy AS (SELECT doc_id, {_tidy} AS text FROM noisy), parts AS (SELECT *, {_ends(strip('text'))} AS s FROM tidy),
 done AS (SELECT doc_id, {strip(r"regexp_replace(CASE WHEN len(s) > 1 AND len(s[-1]) > 20 AND len(regexp_replace(s[-1], '[^\pL]', '', 'g')) / len(s[-1]) < 0.5 THEN array_to_string(s[1 : len(s) - 1], ' ') ELSE text END, '\s{2,}', ' ', 'g')")} AS text FROM parts)"""


@query(f"{TIDY} SELECT doc_id, text FROM done")
def decode_cleanup(spark, d):
    return documents(spark, d).select("doc_id", X.decode_cleanup(F.expr(NOISY)).alias("text"))


_drift = " OR ".join(f"(regexp_matches(s, {q('(?i)' + p)}) AND NOT contains('the high court of california', lower(regexp_extract(s, {q('(?i)' + p)}))))" for p in C.DRIFT_PATTERNS)
_foreign = f"len(list_filter(regexp_extract_all(s, {q(C.SECTION_MENTION)}), lambda m: NOT contains('section 99', lower(m)))) > 0"


@query(f"{TIDY}, kept AS (SELECT doc_id, text, list_filter(list_transform({_ends('text')}, lambda s: {strip('s')}), lambda s: s <> '' AND NOT ({_drift} OR {_foreign})) AS k FROM done) SELECT doc_id, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE text END AS text FROM kept")
def ground_filter(spark, d):
    return documents(spark, d).select("doc_id", X.grounded(F.expr(NOISY), F.lit("The High Court of California"), F.array(F.lit("Section 99"))).alias("text"))


# Metrics -------------------------------------------------------------------------------------------------------------
PAIRS = """SELECT CAST(conv_id AS BIGINT) AS doc_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (turn < last), '') AS source, max(text) FILTER (turn = last) AS summary
 FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id"""


def eval_pairs(spark, d):
    """A conversation's last turn as the summary of all turns before."""
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return turns.select("doc_id", F.array_join(F.slice("t", 1, F.size("t") - 1), "\n").alias("source"), F.element_at("t", -1).alias("summary"))


_tokens = lambda x: f"SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS token FROM pairs"
_prf = "round(coalesce(hits / nullif(nm, 0), 0), 6) AS {0}_precision, round(coalesce(hits / nullif(ns, 0), 0), 6) AS {0}_recall, round(CASE WHEN hits > 0 THEN 2.0 * hits / (nm + ns) ELSE 0 END, 6) AS {0}_f1"


@query(f"""WITH pairs AS ({PAIRS}), a AS (SELECT doc_id, token, count(*) AS n FROM ({_tokens('source')}) GROUP BY ALL), b AS (SELECT doc_id, token, count(*) AS n FROM ({_tokens('summary')}) GROUP BY ALL),
 h AS (SELECT doc_id, sum(least(a.n, b.n)) AS hits FROM a JOIN b USING (doc_id, token) GROUP BY doc_id), s AS (SELECT doc_id, sum(n) AS ns FROM a GROUP BY doc_id), m AS (SELECT doc_id, sum(n) AS nm FROM b GROUP BY doc_id)
 SELECT doc_id, {_prf.format('rouge1')} FROM (SELECT p.doc_id, CAST(coalesce(hits, 0) AS DOUBLE) AS hits, CAST(coalesce(ns, 0) AS DOUBLE) AS ns, CAST(coalesce(nm, 0) AS DOUBLE) AS nm FROM pairs p LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN m USING (doc_id))""")
def rouge1(spark, d):
    found = metrics.rouge1(eval_pairs(spark, d), stemming=False)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query()
def rouge1_stemmed(spark, d):
    return metrics.rouge1(eval_pairs(spark, d))


@query()
def rouge_l(spark, d):
    return metrics.rouge_l(eval_pairs(spark, d))


_known = lambda a, b: f"len(list_filter({a}, lambda w: list_contains({b}, w)))"
_chunked = ORACLE_SQL["word_blocks"].replace("FROM documents", "FROM side")


@query(f"""WITH pairs AS ({PAIRS}), a AS (WITH side AS (SELECT doc_id, source AS text FROM pairs) {_chunked}), b AS (WITH side AS (SELECT doc_id, summary AS text FROM pairs) {_chunked}), ends AS (SELECT doc_id, max(pos) AS last FROM a GROUP BY doc_id),
 x AS (SELECT b.doc_id, {words('a.part')} AS s, {words('b.part')} AS c FROM b JOIN ends USING (doc_id) JOIN a ON a.doc_id = b.doc_id AND a.pos = least(b.pos, ends.last)),
 y AS (SELECT doc_id, coalesce({_known('c', 's')} / nullif(len(c), 0), 0) AS p, coalesce({_known('s', 'c')} / nullif(len(s), 0), 0) AS r FROM x)
 SELECT doc_id, round(avg(p), 4) AS bertscore_precision, round(avg(r), 4) AS bertscore_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 4) AS bertscore_f1 FROM y GROUP BY doc_id""")
def bertscore_means(spark, d):
    return models.similarity_scores(eval_pairs(spark, d))


_sents = ORACLE_SQL["eval_sentences"].replace("FROM documents", "FROM side")
_short = ORACLE_SQL["truncate_words"].replace("FROM documents", "FROM (SELECT doc_id, source AS text FROM pairs)")
NLI = f"WITH pairs AS ({PAIRS}), short AS ({_short}), each AS (WITH side AS (SELECT doc_id, summary AS text FROM pairs) {_sents}), nli AS (SELECT s.doc_id, e.pos AS ord, s.text AS source_text, e.part AS sentence FROM short s LEFT JOIN each e USING (doc_id))"


@query(f"{NLI} SELECT * FROM nli")
def nli_pairs(spark, d):
    return models.inference_pairs(eval_pairs(spark, d))


@query(f"""{NLI}, judged AS (SELECT doc_id, sentence, {_known(words('sentence'), words('source_text'))} * 2 >= len({words('sentence')}) AS yes FROM nli)
 SELECT doc_id, round(coalesce(avg(CASE WHEN sentence IS NOT NULL THEN CAST(yes AS INT) END), 0), 4) AS entailment_ratio, 0.0::DOUBLE AS contradiction_ratio, round(coalesce(avg(CASE WHEN sentence IS NOT NULL THEN CAST(NOT yes AS INT) END), 0), 4) AS neutral_ratio, count(sentence) AS num_sentences_evaluated FROM judged GROUP BY doc_id""")
def entailment_scores(spark, d):
    return models.entailment_scores(eval_pairs(spark, d))


GROUP_TOKENS = 120


@query(rf"""WITH RECURSIVE lists AS (SELECT doc_id, {_ends('text')} AS s FROM documents), parts AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS s FROM lists), sized AS (SELECT *, len({words('s')}) AS n FROM parts),
 walk AS (SELECT doc_id, i, s, n AS held, 0 AS g FROM sized WHERE i = 0 UNION ALL
  SELECT x.doc_id, x.i, x.s, CASE WHEN w.held + x.n > {GROUP_TOKENS} THEN x.n ELSE w.held + x.n END, CASE WHEN w.held + x.n > {GROUP_TOKENS} THEN w.g + 1 ELSE w.g END FROM walk w JOIN sized x ON x.doc_id = w.doc_id AND x.i = w.i + 1)
 SELECT doc_id, CAST(g AS BIGINT) AS pos, string_agg(s, ' ' ORDER BY i) AS part FROM walk GROUP BY doc_id, g""")
def token_groups(spark, d):
    """Sentences packed to what a generator reads: here words are tokens, and there is no prefix."""
    texts = documents(spark, d).withColumn("prefix", F.lit(""))
    return models.groups(texts, GROUP_TOKENS + models.MARGIN).select("doc_id", F.posexplode("groups")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("part"))


def _lead(texts: list[str], settings: dict) -> list[str]:
    """A generator that gives a text's first words."""
    return [" ".join(t.split()[: settings["max_new_tokens"]]) for t in texts]


@query()
def hierarchical_summary(spark, d):
    return models.summarized(documents(spark, d).withColumn("prefix", F.lit("")), _lead, "pegasus", 60, 20, input_max=300)


@query()
def document_chunks(spark, d):
    return chunking.document_chunks(engine.preprocess(marked(spark, d)).withColumn("filename", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")))).select("doc_id", "index", "word_count", "section", "source_file", "text")


@query("WITH s AS (SELECT CAST(conv_id AS BIGINT) AS doc_id, turn, CASE WHEN turn % 4 = 3 THEN -1 ELSE turn * 7 END AS c FROM conversations) SELECT doc_id, round(coalesce(avg(CASE WHEN c <> -1 THEN c END), 0), 6) AS confidence FROM s GROUP BY doc_id")
def word_confidence(spark, d):
    found = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(F.collect_list(F.when(F.col("turn") % 4 == 3, "-1").otherwise((F.col("turn") * 7).cast("string"))).alias("w"))
    return found.select("doc_id", F.round(ocr.word_confidence(F.col("w")), 6).alias("confidence"))


_blocks = lambda x: f"CASE WHEN len({words(x)}) <= 20 THEN [{x}] ELSE list_transform(range(0, len({words(x)}), 20), lambda i: array_to_string(({words(x)})[i + 1 : i + 20], ' ')) END"


@query(f"WITH pairs AS ({PAIRS}), t AS (SELECT doc_id, {_blocks('source')} AS a, {_blocks('summary')} AS b FROM pairs), x AS (SELECT doc_id, a, unnest(range(len(b))) AS block, unnest(b) AS summary_text FROM t) SELECT doc_id, block, least(block, len(a) - 1) AS source_block, a[least(block, len(a) - 1) + 1] AS source_text, summary_text FROM x")
def bertscore_pairs(spark, d):
    return metrics.block_pairs(eval_pairs(spark, d), 20)


@query("""SELECT doc_id % 97 AS doc_id, round(avg(CAST(l = 'entailment' AS INT)), 6) AS entailment_ratio, round(avg(CAST(l = 'contradiction' AS INT)), 6) AS contradiction_ratio, round(avg(CAST(l = 'neutral' AS INT)), 6) AS neutral_ratio, count(*) AS num_sentences_evaluated
 FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'contradiction' WHEN quality = 1 THEN 'entailment' ELSE 'neutral' END AS l FROM labels) GROUP BY doc_id % 97""")
def entailment_ratio(spark, d):
    labels = table(spark, d, "labels").select((F.col("doc_id") % 97).alias("doc_id"), F.when(F.col("toxic") == 1, "contradiction").when(F.col("quality") == 1, "entailment").otherwise("neutral").alias("label"))
    found = metrics.entailment_ratios(labels)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in found.columns[1:4]], "num_sentences_evaluated")


@query("SELECT * FROM (VALUES " + ", ".join(f"({v}, {q(n)}, {q(m)}, {t}, {a}, {b}, {int(a * 0.75)}, {q(s)})" for v, n, _, m, t, a, b, s in C.LEVELS) + ") AS t(value, name, model, top_n, max_length, min_length, target_words, description)")
def levels(spark, d):
    return engine.levels(spark).drop("emoji")
