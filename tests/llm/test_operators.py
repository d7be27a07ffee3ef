"""Each operator against brute force, a round trip or held-out rows, with nulls, blanks, repeats, ties and extra columns."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import decontaminate, flac, html_text, language, pieces, quality, sharding, simhash, substring_dedup, url_rules

ODD = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "x"), (3, ""), (4, " \n\t"), (5, "é▁𝒳 " * 3000), (6, "no-space" * 2000)]


def docs(spark, rows, extra=True):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return table.selectExpr("*", "'en' AS lang", "CAST(NULL AS STRING) AS source", "0.5 AS score", "'x' AS fp0", "1 AS id") if extra else table


def fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), seed=42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(90)) for _ in range(6)]
    rows = list(ODD)
    for i in range(10, 160):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((i, " ".join(w)))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = {(r[0], fingerprint(r[1])) for r in rows}
    assert {(r.id, r.fp0 % 2**64) for r in got} == fps and len(got) == len(rows)
    nodes = sorted({f for _, f in fps})
    group = {f: f for f in nodes}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 4:
                group[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    assert all(r.component_id == least.get(root(r.fp0 % 2**64)) for r in got)
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_tree_finds_every_close_pair():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, (3000, 1), dtype=np.uint64)
    near = fps[:500].copy()
    for k in range(500):
        for b in rng.integers(0, 64, 4):
            near[k, 0] ^= np.uint64(1) << np.uint64(b)
    both = np.concatenate([fps, near])
    met = set()
    for band in simhash.bands(4):
        values = simhash.band_values(both, band)
        homes, visits = {}, {}
        for leaf, of, home in simhash.route(simhash.grow(np.sort(values), 64), values):
            (homes if home else visits).setdefault(leaf, []).extend(of.tolist())
        for leaf, stored in homes.items():
            here = set(stored)
            for k in {*stored, *visits.get(leaf, [])}:
                other = k + 3000 if k < 500 else k - 3000
                if other in here:
                    met.add(min(k, other))
    assert met >= set(range(500))


def test_near_copies_keep_one(spark):
    rng = random.Random(2)
    words = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(300)) for _ in range(4)]
    edited = words[0].split()
    edited[150] = "zzz"
    rows = [(i, w) for i, w in enumerate(words)] + [(9, words[1]), (10, " ".join(edited)), (1, words[1]), (None, words[1])]
    left = simhash.deduplicated(docs(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 0), (False, 1), (False, 2), (False, 3), (True, 0)]
    assert left.columns == docs(spark, rows).columns or set(left.columns) == set(docs(spark, rows).columns)


@pytest.mark.parametrize("block", [1024, 3])
def test_near_copies_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = random.Random(3)
    some = lambda n: [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(n)]
    rows = list(ODD)
    for i in range(10, 200, 10):
        base = some(rng.choice([5, 6, 9, 60, 200]))
        for k in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            rows.append((i + k, " ".join(w + some(rng.choice([0, 0, len(w) // 8])))))
    split = lambda t: t.lower().encode().split()
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := split(t or "")) else set() for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    stay = {i for g, (i, _) in zip(group, rows) if i is None or i == least[g]}
    assert {r.doc_id for r in simhash.deduplicated(docs(spark, rows)).collect()} == stay
    got = simhash.near_copies(docs(spark, rows)).select("id", "component_id").collect()
    assert sorted(map(str, ((r.id, r.component_id) for r in got))) == sorted(str((i, least.get(g))) for g, (i, _) in zip(group, rows))
    assert simhash.near_copies(docs(spark, rows).limit(0)).count() == 0


def test_pieces_round_trip_and_reproduce(spark):
    table = docs(spark, ODD)
    found = pieces.decoded(pieces.encode(table))
    assert all(r.decoded == r.text for r in found.collect()) and found.count() == len(ODD)
    alone = pieces.encode(docs(spark, ODD[:1])).first().pieces
    assert all(r.pieces == alone for r in pieces.encode(table).where("doc_id = 1").collect())
    assert pieces.encode(table.limit(0)).count() == 0


@pytest.mark.parametrize("long", [4096, 2])
def test_pieces_follow_the_lattice_weights(long, monkeypatch):
    monkeypatch.setattr(pieces, "LONG", long)
    own = pieces.vocabulary()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = {model.id_to_piece(i): i for i in range(259, model.get_piece_size())}

    def all_of(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in ids:
                for rest in all_of(s[k:]):
                    yield (ids[s[:k]], *rest)

    weight = {x: float(np.exp(sum(own.logs[i] for i in x))) for x in all_of("▁then")}
    offsets, drawn = pieces.sample([" then"] * 20_000, list(range(20_000)), own)
    for x, w in weight.items():
        share = sum(tuple(drawn[a:b]) == x for a, b in zip(offsets, offsets[1:])) / 20_000
        assert abs(share - w / sum(weight.values())) < 0.015


def test_long_stretches_are_drawn_whole():
    own, rng = pieces.vocabulary(), random.Random(17)
    codes = np.array([ord(rng.choice("theandcouré𝒳")) for _ in range(700)], np.int64)
    for stream in range(20):
        want = own.long_draw(codes, stream, 10_000).tolist()
        assert all(own.long_draw(codes, stream, block).tolist() == want for block in (1, 7, 64))
    text = "the" + "thenandthere" * 750  # no cut in 9,000 characters; a piece runs over character 4,096 as over any like it
    crossed = Counter()
    for key in range(40):
        _, ids = pieces.sample([text], [key], own)
        ends = np.cumsum([len(own.bytes[i]) for i in ids])
        assert pieces.decode(ids.tolist(), own) == text
        crossed.update(k for k in (4096, 4096 + 12) if k not in set(ends.tolist()))
    assert crossed[4096] > 10 and abs(crossed[4096] - crossed[4108]) < 18


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row, up = [i] + [0] * len(text), row
        for j, b in enumerate(text, 1):
            row[j] = min(up[j] + 1, row[j - 1] + 1, up[j - 1] + (a != b))
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    items = [(i, "".join(rng.choice("abcd ") for _ in range(60)).strip()) for i in range(5)] + [(7, None), (8, " ")]
    rows = list(ODD)
    for i in range(20, 60):
        t = list(rng.choice(items[:5])[1])
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("abcdxyz")
        rows.append((i, "".join(rng.choice("abcd ") for _ in range(40)) + "".join(t) + "".join(rng.choice("abcd ") for _ in range(40))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id): r.edits for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            x = decontaminate.normal(x)
            if x and t and len(t) < 500 and (e := distance(x, decontaminate.normal(t))) <= int(len(x) * decontaminate.RATE):
                want[d, i] = e
    assert got == want and want
    kept = decontaminate.clean(docs(spark, rows), bench)
    assert kept.count() == len(rows) - len({d for d, _ in want}) and kept.columns == docs(spark, rows).columns
    assert decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "an item that has no id of its own, twice"), (None, "and another, which is elsewhere"), (4, "an item with an id, of some length")], "item_id long, text string")
    rows = [(1, "Here is an item that has no id of its own, twice, and an item with an id, of some length."), (2, "nothing"), (3, "and another, which is elsewhere")]
    assert [(r.id, r.item_id, r.edits) for r in decontaminate.leaks(docs(spark, rows), bench).collect()] == [(1, None, 0), (1, 4, 0), (3, None, 0)]
    assert [r.doc_id for r in decontaminate.clean(docs(spark, rows), bench).collect()] == [2]


def test_leaks_with_text_ids_and_their_places(spark):
    item = "the quick brown fox jumps over the lazy dog and then rests for a while"
    bench = spark.createDataFrame([("a-1", item), ("b", "q" * 30)], "item_id string, text string")
    edited = item.replace("jumps over", "jumpsy ovr")
    rows = [(1, "xx " + item + " yy"), (2, "some words, " + edited + " more words"), (3, "q" * 5000), (4, "q" * 29)]
    got = {(r.id, r.item_id): r for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    place = lambda r: decontaminate.normal(dict(rows)[r.id])[r.start : r.end]
    assert set(got) == {(1, "a-1"), (2, "a-1"), (3, "b"), (4, "b")}
    assert place(got[1, "a-1"]) == item and place(got[2, "a-1"]) == edited and got[2, "a-1"].edits == 2 and (got[4, "b"].start, got[4, "b"].end, got[4, "b"].edits) == (0, 29, 1)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=12), st.text("ab", max_size=25))
def test_myers_equals_brute_force(item, text):
    edits, end = decontaminate.myers(item, text)
    assert edits == distance(item, text) and distance(item, text[:end]) == edits


def test_flac_round_trip(spark):
    rng = random.Random(4)
    payloads = [b"\0" * 64, bytes(range(256)) * 3, bytes(rng.randrange(256) for _ in range(64 * 19)), (b"x" * 255 + b"\xff") * 9, bytes([128] * 200 + [0] + [128] * 55) * 3]
    media = flac.encode(payloads)
    assert flac.decode(media) == payloads and flac.decode_range(media[2], 100, 900) == payloads[2][100:900]
    broken = bytearray(media[1])
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])
    for r in flac.media_columns(docs(spark, ODD)).collect():
        text = next(t for i, t in ODD if i == r.id and (i is not None or t == "x")) or ""
        payload = text.encode().ljust(max(64, -(-len(text.encode()) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert flac.decode([bytes(r.media)]) == [payload] and r.media_sha256 == hashlib.sha256(r.media).hexdigest()


def repeats(rows, n=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                gone[i : i + n] = True
            seen.add(b[i : i + n])
        starts = int((gone[1:] & ~gone[:-1]).sum()) + int(bool(len(b)) and gone[0])
        out[d] = (len(b), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("salt", [4096, 3])
def test_suffix_dedup_equals_brute_force(spark, salt, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SALT", salt)
    rng = random.Random(5)
    words = ["the", "of", "and", "ñé", "thing", "er", "日"]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(8)]
    some = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    rows = [(i, rng.choice([lambda: rng.choice(base), lambda: some(0, 40) + rng.choice(base)[rng.randint(0, 30) :] + some(0, 40), lambda: "De " * rng.randint(0, 300), lambda: None])()) for i in range(90)]
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.deduplicated(docs(spark, rows)).collect()}
    assert got == repeats(rows)
    cut = substring_dedup.without_repeats(docs(spark, rows + ODD))
    assert cut.count() == len(rows) + len(ODD) and cut.columns == docs(spark, rows).columns


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_fragments_are_settled_in_any_batches(rows):
    rng = random.Random(rows)
    marks = sorted({(rng.randint(0, 9), rng.randint(0, 6), d, rng.randint(0, 3)) for d in range(160)})
    table = pa.table({"anchor": [m[0] for m in marks], "print": [m[1] for m in marks], "doc": [m[2] for m in marks], "start": pa.array([m[3] for m in marks], pa.int32()), "windows": pa.array([-4 if m[3] == 3 else 5 for m in marks], pa.int32())})
    got = [r for b in substring_dedup._settle(iter(table.to_batches(max_chunksize=2)), np.array([7]), 3, rows) for r in b.to_pylist()]
    live = [m for m in marks if m[3] != 3]
    first = {}
    for m in live:
        first.setdefault(m[:2], m)
    several = {h: n for h in range(10) if (n := sum(k[0] == h for k in first)) > 1 or h == 7}
    on = {(m[2], m[0]): several[m[0]] > 3 or m[0] == 7 for m in first.values() if m[0] in several}
    assert {(r["doc"], r["anchor"]): r["cell"] >= 0 for r in got if r["anchor"] is not None} == on
    assert sorted((r["doc"], r["windows"]) for r in got if r["anchor"] is None) == sorted((m[2], 4 if m[3] == 3 else 5) for m in marks if m[3] == 3 or first[m[:2]] != m)


def test_suffix_dedup_of_repeated_rows_and_long_texts(spark, monkeypatch):
    rng = random.Random(15)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    a, b, long = say(60), say(60), say(600_000)
    rows = [(1, a), (1, a), (2, b + " " + a), (3, long), (4, long[2_000_000:2_300_000])]
    got = {(r.doc, r.n_bytes, r.n_removed) for r in substring_dedup.deduplicated(docs(spark, rows)).collect()}
    assert got == {(1, len(a), 0), (2, len(rows[2][1]), len(a)), (3, len(long), 0), (4, 300_000, 300_000)}
    assert substring_dedup.without_repeats(docs(spark, rows)).count() == 5


def test_an_id_with_different_texts(spark):
    rng = random.Random(6)
    a, b, c = (" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(120)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (5, c + a), (-7, c), (5, None), (None, b)]
    assert {(r.doc_id, r.text) for r in simhash.deduplicated(docs(spark, rows)).collect()} == {*rows} - {(5, a)}
    cut = substring_dedup.without_repeats(docs(spark, rows))
    assert sorted(map(str, ((r.doc_id, r.text) for r in cut.collect()))) == sorted(map(str, [(3, a), (5, ""), (5, b), (5, ""), (-7, c), (5, None), (None, b)]))
    got = sorted((r.doc, r.n_bytes, r.n_removed) for r in substring_dedup.deduplicated(docs(spark, rows)).collect() if r.doc == 5)
    assert got == sorted([(5, 0, 0), (5, len(b), 0), (5, len(a), len(a)), (5, len(c + a), len(c + a))])


def test_language(spark):
    rng = random.Random(6)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, say("abcde"), "aa") for i in range(40)] + [(i, say("uvwxyz"), "zz") for i in range(40, 80)] + [(90, None, "aa"), (91, "12 !", "zz"), (92, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0 AS score")
    found = {r.doc_id: r for r in language.predict(table, language.train(table.where("doc_id % 2 = 0"))).collect()}
    assert all(found[i].lang_pred == rows[i][2] and 0 <= found[i].score <= 1 for i in range(80))
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (90, 91, 92))
    assert {r.lang_pred for r in language.predict(table, language.train(table.limit(0))).collect()} == {"und"}


odd_texts = st.text(st.sampled_from("abé𝒳 \n.1▁"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(odd_texts, st.integers(1, 9))
def test_pieces_of_long_texts_count_like_the_whole(text, piece):
    whole, part = language.counts_of(text), language.counts_of(text, piece)
    counts = lambda x: x if x is None or x.dtype == np.int64 else np.bincount(x, minlength=language.BUCKETS)
    assert (whole is None) == (part is None) and (whole is None or (counts(whole) == counts(part)).all())
    of = lambda n: np.sort(np.concatenate([np.zeros(0, np.uint32), *quality._features(text, n)]))
    assert (of(1000) == of(piece)).all()


def test_features_are_those_of_the_docstring():
    words, grams = ["ab", "ab", "c"], " ab ab c "
    want = sum(len({grams[i : i + n] for i in range(len(grams) - n + 1)}) for n in (3, 4, 5)) + 2 + 1
    found = np.concatenate(list(quality._features("ab\nab  c")))
    assert len(set(found.tolist())) == want and len(found) == sum(len(grams) - n + 1 for n in (3, 4, 5)) + len(words) + 1


def naive_bayes(rows, text):
    """Posteriors by dictionaries of hashed n-grams."""
    def bucket(g):
        full, h = 2**32 - 1, 0
        for n, x in enumerate(map(ord, g)):
            h = x * 0x9E3779B1 & full if not n else ((h ^ h >> 15) * 0x85EBCA6B + x * 0xC2B2AE35) & full if n == 1 else ((h ^ h >> 13) * 0x27D4EB2F + x * 0x165667B1) & full
        return h >> 16

    def grams(t):
        c = re.sub(" +", " ", "".join(x if x.isalpha() else " " for x in f" {t.lower()} "))
        return [bucket(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)]

    langs, logs = sorted({x for _, x in rows}), {}
    for x in langs:
        own = Counter(g for t, y in rows if y == x for g in grams(t))
        total = sum(own.values()) + language.SMOOTH * language.BUCKETS
        seen = grams(text)
        logs[x] = sum(np.log((own[g] + language.SMOOTH) / total) for g in seen) * min(1, language.TEMPER / len(seen)) + np.log(sum(y == x for _, y in rows) / len(rows))
    top = max(logs.values())
    return {x: np.exp(v - top) / sum(np.exp(w - top) for w in logs.values()) for x, v in logs.items()}


def test_language_equals_brute_force(spark):
    rng = random.Random(16)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12)))
    rows = [(say(letters), name) for letters, name in (("abcde", "x"), ("cdefg", "y"), ("efgab", "z")) for _ in range(12)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    tests = [say("abcdefg") for _ in range(30)]
    found = {r.text: r for r in language.predict(spark.createDataFrame([(t,) for t in tests], "text string"), language.train(table)).collect()}
    for t in tests:
        want = naive_bayes(rows, t)
        assert abs(found[t].score - max(want.values())) < 1e-3 and want[found[t].lang_pred] > max(want.values()) - 1e-3


def test_a_session_may_name_its_batches_in_any_unit(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for unit in ("64m", "1k", "2097152"):
        spark.conf.set(key, unit)
        assert language.predict(docs(spark, ODD), (["x"], np.zeros((language.BUCKETS + 1, 1), np.float32))).count() == len(ODD)
    assert spark.conf.get(key) == "2097152"


def test_url_verdicts(spark):
    urls = ["http://a.com/x", "https://B.Example.com/en/1?q", "https://www.example.com/en/", "http://example.com/fr/1", "http://x.net/es/1#t", "http://ynet/es/", "nothing", None, "http://net/fr/2", "ftp://u.org"]
    table = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    labelled = spark.createDataFrame([(f"http://spam.org/{i}", "block") for i in range(50)] + [(f"http://good.org/{i}", "allow") for i in range(50)], "url string, verdict string")
    got = {r.page_id: r for r in url_rules.judge(table, labelled).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(10)] == [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/fr/", "block"), (None, "allow")]
    assert (got[1].host, got[1].path, got[7].host) == ("b.example.com", "/en/1", "")
    spam = spark.createDataFrame([(1, "https://spam.org/new")], "page_id long, url string")
    assert url_rules.judge(spam, labelled).first().verdict == "block" and url_rules.judge(spam, labelled.limit(0)).first().verdict == "allow"


def test_url_rules_are_mined_from_all_labelled_rows(spark):
    side = "IF(id % 2 = 0, 'spam', 'good')"
    many = spark.range(600_000).selectExpr(f"concat('http://', {side}, (id DIV 2) % 40, '.org/', id) AS url", f"IF({side} = 'spam', 'block', 'allow') AS verdict")
    table = spark.createDataFrame([(i, f"http://spam{i}.org/new") for i in range(40)], "page_id long, url string")
    assert {r.verdict for r in url_rules.judge(table, many).collect()} == {"block"}


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(18)
    rows = []
    for _ in range(200):
        tokens = sorted(rng.sample(["h:a", "h:b", "p:x", "p:y", "q:z", "q:w"], rng.randint(1, 4)))
        bad = "p:x" in tokens and "h:a" in tokens or rng.random() < 0.2
        rows.append((tokens + (["p:same"] if "p:x" in tokens else []), "block" if bad else "allow"))
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.01, 0.6, 5)
    known, every = ["h:a", "h:b", "p:same", "p:y", "q:z", "q:w"], {}  # p:x comes with p:same always, the first of both enters
    for k in range(1, 6):
        for c in itertools.combinations(sorted(known), k):
            having = [v for t, v in rows if set(c) <= set(t)]
            for v in ("allow", "block"):
                if (m := having.count(v)) >= 5 and m / len(having) >= 0.6 and not any(every.get((s, v), 0) >= m / len(having) for j in range(1, k) for s in itertools.combinations(c, j)):
                    every[c, v] = m / len(having)
    assert {(tuple(r[0]), r[1]): round(r[2], 9) for r in got} == {k: round(x, 9) for k, x in every.items()} and len(got) > 3
    urls = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(900, []), (901, ["none"])], "i long, t array<string>")
    found = {r.i: r.v for r in urls.select("i", url_rules.mined_verdict(F.col("t"), got).alias("v")).collect()}
    for i, t in [*((i, t) for i, (t, _) in enumerate(rows)), (900, []), (901, ["none"])]:
        assert found[i] == next((r[1] for r in got if set(r[0]) <= set(t)), None)


def test_quality(spark):
    rng = random.Random(7)
    say = lambda bad: " ".join("".join(rng.choice("abcde") for _ in range(5)) + ("###" if bad else "") for _ in range(40))
    rows = [(i, say(i % 2), 1 - i % 2) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    found = quality.score(docs(spark, [(i, t) for i, t, _ in rows] + ODD), quality.train(table.where("doc_id < 120"))).collect()
    held = [r for r in found if r.doc_id is not None and 120 <= r.doc_id < 200]
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in held) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in quality.score(docs(spark, ODD), quality.train(table.limit(0))).collect()} == {0.5}


def test_shards(spark):
    rng = random.Random(8)
    rows = [(i, "t" * (i % 50), rng.choice(["hot", "hot", "hot", "b", None])) for i in range(1003)] + [(5, "again", "b"), (5, "again", "b"), (None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(table, 10).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(x.slot for x in b) == list(range(len(b))) for b in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    hot = [sum(x.source == "hot" for x in b) for b in by.values()]
    assert max(hot) - min(hot) <= 2
    assert all(r.size == len(next(t or "" for i, t, _ in rows if i == r.id)) + 16 for r in got if r.id not in (5, None))
    assert sharding.interleave(table.limit(0), 10).count() == 0


def test_shards_of_odd_sources_and_ids(spark):
    rows = [(None, f"text {i}", ["", None, "a"][i % 3]) for i in range(300)] + [(7, "same", "")] * 30
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 11).collect()
    assert len(got) == 330 and Counter(r.source for r in got) == {"": 130, None: 100, "a": 100}
    for s in ("", None, "a"):
        each = Counter(r.shard for r in got if r.source == s)
        assert max(each.values()) - min(each.get(k, 0) for k in range(11)) <= 2


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>A &amp; B</h1><p><b>One  line\n here, it says.<br>more<p>Two of them, as told.</p></article><section class='comments'><div class='comment'><p>I like it.</p></div></section><footer>&copy; me</footer></body></html>"
    table = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>" + "Some words here, and more of them. " * 20_000)], "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    got = [(r.page_id, r.text) for r in html_text.extract(table).collect()]
    assert got[0][1] == got[1][1] == "A & B\nOne line here, it says. more\nTwo of them, as told." and got[2][1] == got[3][1] == "" and got[4][1]


def test_hostile_pages_take_linear_time():
    extract = html_text.Extractor(html_text.default_model())
    began = time.time()
    for page in ("<a" * 500_000, "<div>" * 200_000 + "</p>" * 200_000 + "</div>" * 200_000, "<svg>" * 100_000, "<noscript>" * 100_000, "<!" * 500_000, '<a "> ' * 100_001, "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, '<a b="' * 100_000 + ">", "<b " * 300_000 + ">", "<td>" * 200_000, "<!--" * 200_000):
        extract(page)
    assert time.time() - began < 60
    text = lambda page: [b[1] for b in html_text.blocks(page, [0.0] * html_text.WIDTH)]
    assert text("<p>a < b</p>c<u f='>'>d<p class=\"x>e") == ["a < b", "cd", "e"] and text("a <b c") == ["a <b c"] and text("x<!-- y") == ["x"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<li>", "</li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<svg>", "</svg>", "<a href='x>'>", "</a>", "<br>", "<!--", "-->", "<script>", "</script>", "t", " ", "<", ">", "'", '"']), max_size=30))
def test_blocks_of_any_tags(tags):
    found = html_text.blocks("".join(tags), [0.0] * html_text.WIDTH)
    assert all(b[1] == " ".join(b[1].split()) != "" for b in found)


def crf_brute_force(scores, tr):
    best = max(itertools.product((0, 1), repeat=len(scores)), key=lambda y: sum(s for s, k in zip(scores, y) if k) + sum(tr[a][b] for a, b in zip(y, y[1:])))
    return [bool(k) for k in best]


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    for n in range(1, 9):
        for _ in range(20):
            scores, tr = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2))
            assert html_text.viterbi(scores.tolist(), tr) == crf_brute_force(scores, tr)


def test_crf_held_out():
    weights, transitions = html_text.default_model()
    lead, right, total = weights[:, 1] - weights[:, 0], 0, 0
    for rows, labels in html_text.examples(html_text.labelled_pages(60, seed=99)):
        guess = html_text.viterbi([float(sum(lead[i] for i in (*a, *b))) for a, b in rows], transitions)
        right, total = right + sum(int(g) == y for g, y in zip(guess, labels)), total + len(labels)
    assert right > 0.98 * total


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    say = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(120))
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    shared = say()
    rows = [(i, say(), "en", "s", 1) for i in range(30)]
    rows += [(30, rows[3][1], "en", "s", 1), (31, say() + " " + item + " " + say(), "en", "s", 1), (32, "123 456", "en", "s", 7), (33, None, None, None, None)]
    rows += [(40 + i, f"{say()} {say()} {say()} {shared} {say()} {say()} {say()}", "en", "s", 1) for i in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(30), 40, 41} and all(r.lossless for r in got.values())
    assert shared in got[40].text and shared not in got[41].text and got[41].n_chars == len(got[41].text)


def test_pipeline_without_languages_or_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, pieces string"
    rows = [(1, "some words", None, None, 10, "x"), (2, "123", None, None, 3, None), (None, None, None, None, None, None)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [1]
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
