import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.porter import stem
from docloom.operators import chunks, metrics, pages, vectors
from docloom.plans import engine, models
from docloom.sources import ocr, readers, writers


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_sentences(spark):
    cut = lambda t: one(spark, t, X.sentences(F.col("t")).alias("s")).s
    assert cut("Mr. Rao came. He left.") == ["Mr. Rao came.", "He left."]
    assert cut("Done. Ok it. no break") == ["Ok it. no break"]
    assert cut("") == []


@pytest.mark.parametrize(("n", "sizes"), [(393, [393]), (394, [394]), (401, [400, 51]), (751, [400, 400, 51])])
def test_windows(spark, n, sizes):
    parts = one(spark, " ".join(["w"] * n), X.within_limit(F.array("t")).alias("s")).s
    assert [len(p.split()) for p in parts] == sizes


def test_cleaning(spark):
    assert one(spark, "12\n1234\n1 2", X.without_page_numbers(F.col("t")).alias("x")).x == "1234\n1 2"
    assert one(spark, " a \t b\r\n\n\n\nc ", X.normal_space(F.col("t")).alias("x")).x == "a b\n\nc"
    assert one(spark, "Section 3(1)", X.normal_citation(F.col("t")).alias("x")).x == "Section 3 (1)"


def typed(spark, *types):
    rows = [(1, i, f"text {i}", t) for i, t in enumerate(types)]
    return spark.createDataFrame(rows, "doc_id long, page_index long, text string, page_type string")


def test_sections(spark):
    found = {r.section: r for r in pages.sections(typed(spark, "metadata", "facts", "unknown", "order")).collect()}
    assert found["facts"].text == "text 1\ntext 2" and found["facts"].page_range == [3]
    assert found["order"].text == "text 3" and found["order"].page_range == [3]
    (row,) = pages.sections(typed(spark, "facts", "facts")).collect()
    assert row.text == "text 0\n\ntext 1" and row.page_range == [1, 1]


def test_headers(spark):
    def header(*texts):
        return pages.repeated_header(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, page_index long, text string")).first().header

    assert header("A line of more than twenty chars") is None
    assert header("A line of more than twenty chars", "Another line of many characters") == "A line of more than twenty chars"
    assert header("x" * 20, "x" * 20) is None


def test_citations(spark):
    found = spark.createDataFrame([(1, 0, "Section 3(1)"), (1, 1, "section  3 (1)")], "doc_id long, ord long, citation string")
    row = pages.unique_citations(found).first()
    assert (row.total_found, row.unique_citations) == (2, ["Section 3 (1)"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=8))
def test_chunks_keep_words(sizes):
    text = "\n\n".join(" ".join(f"P{i}w{j}" for j in range(n)) + "." for i, n in enumerate(sizes))
    made = chunks.chunk(text)
    seen = {w for c in made for w in c[1].split()}
    assert seen == set(text.split()) and [c[0] for c in made] == list(range(len(made)))


def test_chunk_limits():
    assert len(chunks.chunk("w " * 500)) == 1
    assert chunks.chunk("") == chunks.chunk(" \n ") == []


def test_selection(spark):
    rows = [(1, i, None, [float(i == k) for k in range(8)] if i != 7 else [1.0] + [0.0] * 6 + [0.001]) for i in range(8)] + [(2, 0, None, [0.0] * 8)]
    table = spark.createDataFrame(rows, "doc_id long, pos long, section string, embedding array<float>")
    intents = [("a", [1.0] + [0.0] * 7)]
    chosen = {(r.doc_id, r.pos) for r in vectors.select(table, intents, 5).collect()}
    assert (2, 0) in chosen and len([c for c in chosen if c[0] == 1]) == 5
    assert not {(1, 0), (1, 7)} <= chosen  # near copies


def test_metrics(spark):
    pairs = spark.createDataFrame([(1, "the cats ran", "the cat ran home"), (2, "", "x"), (3, "same words here", "same words here")], "doc_id long, source string, summary string")
    r1 = {r.doc_id: r for r in metrics.rouge1(pairs).collect()}
    assert r1[1].rouge1_recall == 1.0 and r1[1].rouge1_precision == 0.75 and r1[2].rouge1_f1 == 0 and r1[3].rouge1_f1 == 1
    rl = {r.doc_id: r for r in metrics.rouge_l(pairs).collect()}
    assert rl[3].rougeL_f1 == 1 and rl[2].rougeL_f1 == 0
    assert [(r.block, r.source_block) for r in metrics.block_pairs(spark.createDataFrame([(1, "a b", "a b c")], "doc_id long, source string, summary string"), 1).orderBy("block").collect()] == [(0, 0), (1, 1), (2, 1)]


def test_stems():
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "sky", "adoption", "controlling", "rate")] == ["caress", "poni", "relat", "hop", "agre", "sky", "adopt", "control", "rate"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert metrics.lcs(a, b) == table[-1][-1]


def test_levels(spark):
    assert engine.level(2)["target_words"] == 600 and engine.levels(spark).count() == 4
    with pytest.raises(ValueError):
        engine.level(5)
    with pytest.raises(NotImplementedError):
        engine.summarize(typed(spark, "facts"), 1)


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.PDF").write_bytes(b"bad")

    def decode(content):
        if content == b"bad":
            raise ValueError("broken")
        return [(t, "text", None) for t in content.decode().split("|")]

    rows = readers.pdf_pages(spark, str(tmp_path), decode).orderBy("filename", "page").collect()
    assert [(r.filename, r.page, r.text) for r in rows] == [("a.pdf", 1, "one"), ("a.pdf", 2, "two"), ("b.PDF", None, None)] and "broken" in rows[2].error
    (tmp_path / "d.json").write_text('{"filename": "d", "pages": [{"page": 1, "text": "x"}]}')
    assert [(r.doc_id, r.text) for r in readers.exploded(readers.json_documents(spark, str(tmp_path))).collect()] == [("d", "x")]
    lines = writers.summary_lines(spark.createDataFrame([(1, "1. [FACTS] a\nplain")], "doc_id long, summary string")).orderBy("line_no").collect()
    assert [r.bold for r in lines] == [True, False]


def test_stream(spark, tmp_path):
    from docloom.streaming.pages import preprocessed_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.json").write_text('{"filename": "d", "pages": [{"page": 1, "text": "Learned counsel spoke."}]}')
    preprocessed_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_private_characters_are_no_sentence_ends(spark):
    assert one(spark, "One \ue000 two. Three etc. Four  Mr.\n(Five) six.", X.sentences(F.col("t")).alias("s")).s == ["One \ue000 two.", "Three etc. Four  Mr. (Five) six."]


def test_long_texts_are_summarised_in_groups(spark):
    calls = []

    def generate(texts, settings):
        calls.append((len(texts), settings["max_new_tokens"], settings["min_new_tokens"]))
        return [" ".join(t.split()[:2]) for t in texts]

    rows = [(1, "", "one two three."), (2, "", " "), (3, "p ", " ".join(f"Word{i} is here now." for i in range(30))), (4, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, prefix string, text string")
    got = {r.doc_id: r.summary for r in models.summarized(table, generate, "pegasus", 300, 100, input_max=60).collect()}
    assert got == {1: "one two", 2: "", 3: "p p", 4: ""}
    parts = models.groups(table.where("doc_id = 3"), 60).first().groups
    assert " ".join(parts) == rows[2][2] and all(len(p.split()) <= 60 - 32 - 1 for p in parts)
    empty = models.summarized(table.where("doc_id = 3"), lambda t, s: [x if len(x.split()) > 60 else "" for x in t], "pegasus", input_max=60).first().summary
    assert empty.startswith("p Word0")
    long = models.summarized(table.where("doc_id = 3"), lambda t, s: t, "pegasus", input_max=60).first().summary
    assert long.startswith("p Word0") and len(long.split()) > 60


def test_generator_settings():
    s = models.settings("led", 2000, 1500, 100)
    assert (s["max_new_tokens"], s["min_new_tokens"], s["num_beams"]) == (1022, 511, 4) and s["global_attention"] == [*range(64), *range(68, 100)]
    assert models.settings("pegasus", 10, 0)["min_new_tokens"] == 1 and len(models.settings("led", 9, 9, 50)["global_attention"]) == 50
    models.register("mine", lambda: "loaded")
    assert models.model("mine") == "loaded"
    with pytest.raises(ValueError):
        models.model("none")


def test_evaluation_with_backends(spark):
    pairs = spark.createDataFrame([(1, "The cat sat on the mat.", "The cat sat there today."), (2, "x", "")], "doc_id long, source string, summary string")
    got = {r.doc_id: r for r in engine.evaluate(pairs, label=lambda a, b: [0] * len(a)).collect()}
    assert got[1].contradiction_ratio == 1 and got[1].num_sentences_evaluated == 1 and got[2].num_sentences_evaluated == 0 and got[2].rouge1_f1 == 0
    assert got[1].bertscore_precision == 0.6 and got[1].bertscore_recall == 0.5 and got[1].rouge1_f1 == 0.5455
    assert engine.evaluate(pairs, ("rouge", "unknown")).columns == ["doc_id", "rouge1_precision", "rouge1_recall", "rouge1_f1", "rougeL_precision", "rougeL_recall", "rougeL_f1"]
    text = engine.evaluate(pairs).select(writers.evaluation_json(engine.evaluate(pairs).columns[1:]).alias("j")).first().j
    assert set(json.loads(text)) == {"rouge", "bertscore", "entailment"}


def test_centroids_of_null_and_empty_vectors(spark):
    table = spark.createDataFrame([(1, 0, None, None), (1, 1, None, [1.0, 3.0]), (1, 2, None, [3.0, 5.0]), (2, 0, None, None), (3, 0, None, [])], "doc_id long, pos long, section string, embedding array<float>")
    assert {r.doc_id: r.centroid for r in vectors.centroid(table).collect()} == {1: [2.0, 4.0], 2: [], 3: []}
    got = {(r.doc_id, r.pos): (r.global_score, r.intent_scores) for r in vectors.similarities(table.join(vectors.centroid(table), "doc_id"), [("a", [1.0, 0.0])]).collect()}
    assert got[1, 0] == got[3, 0] == (None, None) and abs(got[1, 1][1][0] - 10**-0.5) < 1e-6


def test_mean_pooling(spark):
    row = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "t array<array<double>>, m array<double>").select(vectors.mean_pooled(F.col("t"), F.col("m")).alias("x")).first()
    assert row.x == [2.0, 3.0]


def test_ocr(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 30)).astype(np.uint8)
    mirrored = np.pad(image.astype(float), 60, mode="symmetric")
    w = np.exp(-0.5 * (np.arange(-60, 61) / 15) ** 2)
    want = (np.outer(w, w) * mirrored[10 : 10 + 121, 7 : 7 + 121]).sum() / w.sum() ** 2
    assert abs(ocr.gaussian(image)[10, 7] - want) < 1e-9 and set(np.unique(ocr.adaptive_threshold(image))) <= {0, 255}
    for method in ocr.METHODS:
        made = ocr.prepared(rng.integers(0, 256, (20, 50, 3)).astype(np.uint8), method)
        assert made.shape == (800, 2000) and set(np.unique(made)) <= {0, 255}
    assert (ocr.resized(np.full((5, 7), 9, np.uint8), 21, 10) == 9).all()
    assert ocr.confidence_mean(["-1", "90", "80"]) == 85 and ocr.confidence_mean(["-1"]) == 0

    def read(image):
        if image.mean() > 1000:
            raise ValueError
        return " text ", ["50", "-1"]

    assert ocr.ocr_decoder(lambda b: [image] * 2, read)(b"") == [("text", "ocr", 50.0)] * 2
    rows = spark.createDataFrame([([(" ab ", 0.0), ("abc", 10.0), ("x", 20.0)],), ([],)], "a array<struct<text:string,confidence:double>>")
    assert [tuple(r.x) for r in rows.select(ocr.best_attempt(F.col("a")).alias("x")).collect()] == [("x", 20.0), ("", None)]


def test_text_or_pdf_and_counters(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one||two")
    (tmp_path / "b.pdf").write_bytes(b"|")
    (tmp_path / "c.txt").write_text("plain \u00e9")
    decode = lambda content: [(t, "text", None) for t in content.decode().split("|")]
    rows = {r.filepath.rsplit("/", 1)[-1]: (r.text, r.error) for r in readers.text_or_pdf(spark, str(tmp_path), decode).collect()}
    assert rows == {"a.pdf": ("one\ntwo", None), "b.pdf": (None, "no text in this PDF"), "c.txt": ("plain \u00e9", None)}
    pages = readers.pdf_pages(spark, str(tmp_path), lambda b: decode(b) if b"one" in b else 1 / 0)
    assert tuple(engine.batch_counters(pages).first()) == (1, 1)
    (stats,) = readers.document_stats(pages).collect()
    assert (stats.num_pages, stats.total_characters, [p.text for p in stats.pages]) == (3, 6, ["one", "", "two"])
    writers.write_each(readers.document_stats(pages), str(tmp_path / "out"))
    assert (tmp_path / "out" / "stem=a").is_dir()


def test_requests():
    assert engine.checked_request("a.PDF", "2", 5)["name"] == "Detailed"
    for args, status in ((("a.txt", 1, 5), 400), (("a.pdf", 9, 5), 400), (("a.pdf", "x", 5), 400), (("a.pdf", 1, 5, "elsewhere"), 400), (("a.pdf", 1, 0), 422)):
        with pytest.raises(engine.RequestError) as e:
            engine.checked_request(*args)
        assert e.value.status == status


def test_document_chunks_take_the_first_text_there_is(spark):
    table = spark.createDataFrame([(1, None, "body", "a.pdf"), (2, "summary", "body", None), (3, None, " ", "c.pdf")], "doc_id long, summary_text string, text string, filename string")
    assert sorted((r.doc_id, r.text, r.source_file) for r in chunks.document_chunks(table).collect()) == [(1, "body", "a.pdf"), (2, "summary", "unknown")]


def test_command_line(spark, tmp_path):
    from docloom.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.json").write_text('{"filename": "d.pdf", "pages": [{"text": ""}, {"text": ""}, {"text": ""}, {"text": "Learned counsel spoke of it. The appeal is dismissed."}]}')
    for job in ("preprocess", "chunk", "summarize"):
        main([job, str(tmp_path / "in"), str(tmp_path / job)])
        assert spark.read.json(str(tmp_path / job)).count() == 1
    for side in ("s", "t"):
        (tmp_path / side).mkdir()
        (tmp_path / side / "d.txt").write_text("The cat sat on the mat.")
    main(["evaluate", "--source", str(tmp_path / "s"), "--summary", str(tmp_path / "t"), "--json", str(tmp_path / "m")])
    assert json.loads(spark.read.json(str(tmp_path / "m")).first().metrics)["rouge"]["rouge1_f1"] == 1.0
