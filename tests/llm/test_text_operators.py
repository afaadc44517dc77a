"""Operators 1 to 5, 7 and 8 against plain versions, and their edge cases."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postline.llm import brown, chat, decontam, hdlang, license, pieces, queries, textops, urlfilter

SF = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [None, "", " ", "\n\n", "a", "É", "x" * 5000, "one two three four five six", "one two three four five six", "\x00 \x00", "日本 語"]


def texts_df(spark, texts, extra=""):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra or 'words'} string").repartition(3)


def sample(spark):
    return [(r.doc_id, r.text) for r in textops.table(spark, SF, "documents").select("doc_id", "text").collect()]


# --- shared helpers -------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab É\n\t字.", max_size=30)), max_size=8))
def test_word_spans_and_shingles(texts):
    data, offsets = textops.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = textops.word_spans(data, offsets, textops.WORD)
    raw = data.tobytes()
    want = [[w for w in re.split(SPACE.encode(), (t or "").encode()) if w] for t in texts]
    assert [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])] == want
    hasher = textops.Hasher(1)
    h, who = hasher.shingles(hasher.words(data, starts, ends), first)
    sets = [{tuple(x.lower() for x in w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in want]
    named = {}
    for d, s in enumerate(sets):
        mine = {int(x) for x in h[who == d]}
        assert len(mine) == len(s)
        assert named.setdefault(frozenset(s), mine) == mine


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 50, "", "c", "d" * 9])], ["i", "text"])
    parts = list(textops.slices(iter([batch, batch.slice(0, 0)]), "text", 12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(6)) and len(parts) > 2


def test_drop_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "doc_id long, _drop string")
    gone = spark.createDataFrame([(2,), (None,)], "x long")
    for bound in (500_000, 0):
        assert [r.doc_id for r in textops.drop_ids(docs, gone, "doc_id", bound).collect()] == [1]


# --- 1 --------------------------------------------------------------------

def tokens(t):
    return [w for w in re.split(SPACE, (t or "").translate(LOWER)) if w] + ["\n"]


def brown_expected(rows):
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    return {i: (len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, sum(math.log10((train[w] + .5) / (n + .5 * (v + 1))) for w in tokens(t)))
            for i, t in rows}


@pytest.mark.parametrize("known", [brown.KNOWN, 40])
def test_brown_base_columns_and_gain(spark, known):
    rows = sample(spark)
    docs = textops.table(spark, SF, "documents")
    got = brown.score(docs, queries._remainder(5) != 1, known_words=known, unit_words=min(known, brown.WORDS), rounds=4).collect()
    want = brown_expected(rows)
    assert len(got) == len(rows)
    for r in got:
        n, k, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, k, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.perplexity == pytest.approx(10 ** (-r.score / n))
    held = [r for r in got if r.held_out]
    if known == brown.KNOWN:
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_brown_model_sums_to_one(spark):
    """Transitions and emissions of the model are distributions: the probabilities
    of all one-word continuations (each class with one unseen word) add up to one."""
    docs = texts_df(spark, ["a b", "a b a", "c", None] * 5)
    seen = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "")], "doc_id long, text string")
    train = docs.withColumn("doc_id", F.col("doc_id") * 0).select("doc_id", "text")
    everything = train.withColumn("t", F.lit(True)).unionByName(seen.withColumn("doc_id", F.col("doc_id") + 100).withColumn("t", F.lit(False)))
    got = {r.doc_id: r.score for r in brown.score(everything, F.col("t"), n_classes=4, rounds=2).where("doc_id >= 100").collect()}
    assert all(math.isfinite(x) and x < 0 for x in got.values())
    assert 10 ** got[103] < 1 and got[100] < 0


def test_best_class_is_the_best_of_all_moves():
    rng = np.random.RandomState(0)
    n_classes, words = 4, 12
    of = np.arange(words) % n_classes
    text = [0]
    while len(text) < 200 or text[-1] == text[0]:      # no word stands beside itself
        text.append((text[-1] + 1 + rng.randint(words - 1)) % words)
    counts = np.zeros((words, words))
    np.add.at(counts, (text, text[1:] + text[:1]), 1)

    def likelihood(cls):
        n = np.zeros((n_classes, n_classes))
        for i in range(words):
            for j in range(words):
                n[cls[i], cls[j]] += counts[i, j]
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(n) - f(n.sum(0)) - f(n.sum(1))

    for w in range(words):
        before = np.array([counts[of == c, w].sum() for c in range(n_classes)])
        after = np.array([counts[w, of == c].sum() for c in range(n_classes)])
        big = np.array([[counts[np.ix_(of == a, of == b)].sum() for b in range(n_classes)] for a in range(n_classes)])
        b, better = brown.best_class(int(of[w]), before, after, big, big.sum(1))
        gains = []
        for c in range(n_classes):
            moved = of.copy()
            moved[w] = c
            gains.append(likelihood(moved) - likelihood(of))
        assert b == int(np.argmax(gains)) and better == pytest.approx(max(gains), abs=1e-9)


def test_brown_edges(spark):
    got = {r.doc_id: r for r in brown.score(texts_df(spark, EDGE), F.col("doc_id") >= 0, rounds=1).collect()}
    assert len(got) == len(EDGE)
    assert [got[i].n_tokens for i in (0, 1, 2, 3, 4)] == [1, 1, 1, 1, 2]
    assert got[7].score == got[8].score and all(math.isfinite(r.score) for r in got.values())
    none = brown.score(texts_df(spark, EDGE), F.col("doc_id") < 0, rounds=1).collect()
    assert {(r.n_known, r.train_tokens) for r in none} == {(0, 0)} and all(math.isfinite(r.score) for r in none)
    assert brown.score(texts_df(spark, EDGE).where("false"), F.col("doc_id") >= 0, rounds=1).count() == 0


# --- 2 --------------------------------------------------------------------

def test_url_parts_rules_and_list(spark):
    urls = ["https://a.example.org/en/1?x#y", "http://Example.ORG/es/", "http://org", "http://org/", "x://com/fr/9", "http://m.com/de/", "http://notorg/",
            "http://www.a.net/p/?utm_source=feed", "http://a.net/p", "https://a.net/p/?ref=1#z", "http://a.net/p?q=1", "nothing", None, "", "://", "http://a.net/p"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string")
    listed = pages.where(F.col("url").contains("feed")).select(urlfilter.canonical(F.col("url")))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, listed).collect()}
    assert got == {0: ("a.example.org", "/en/1", "example.org/en/1", "block"), 1: ("example.org", "/es/", "example.org/es/", "block"), 2: ("org", "", None, "allow"),
                   3: ("org", "/", "org/", "allow"), 4: ("com", "/fr/9", "com/fr/", "allow"), 5: ("m.com", "/de/", "com/de/", "block"), 6: ("notorg", "/", None, "allow"),
                   7: ("www.a.net", "/p/", None, "block"), 8: ("a.net", "/p", None, "block"), 9: ("a.net", "/p/", None, "block"), 10: ("a.net", "/p", None, "allow"),
                   11: ("", "", None, "allow"), 12: ("", "", None, "allow"), 13: ("", "", None, "allow"), 14: ("", "", None, "allow"), 15: ("a.net", "/p", None, "block")}
    assert urlfilter.judge(pages.where("false"), listed.where("false")).count() == 0
    assert urlfilter.judge(pages, listed.where("false")).where("listed").count() == 0


@pytest.mark.parametrize("blocks", [urlfilter.MAX_BLOCKS, 0])
def test_bloom_has_no_false_negatives_and_few_hits(spark, monkeypatch, blocks):
    monkeypatch.setattr(urlfilter, "MAX_BLOCKS", blocks)
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = rows.where("cast(substr(key, 2) as int) < 5000")
    found = urlfilter.possible(rows, listed, 5000).where("maybe").select("key")
    assert listed.join(found, "key", "left_anti").count() == 0
    assert found.count() < 5000 + 15_000 * 0.05
    assert "PythonUDF" not in found._jdf.queryExecution().toString()


# --- 3 --------------------------------------------------------------------

def license_expected(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in license.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return (len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
            ",".join(sorted({x for _, x in places})))


def test_license_base_matches_plain_version(spark):
    more = ["CC-BY cc by/CC  BY", "the gnu general public license gnu General Public License", "xcc by cc byx", "MIT License, mit license é apache\nlicense"]
    rows = sample(spark) + [(10_000 + i, t) for i, t in enumerate(EDGE + more)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, places string")
    got = {r.doc_id: r for r in license.report(license.scan(df)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_expected(t)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert license.report(license.scan(df.where("false"))).count() == 0


def test_license_rules_are_many_ordered_and_gated():
    made = license.rules()
    assert len(made) > 300 and [r.priority for r in made] == sorted(r.priority for r in made)
    scanner = license.Scanner(made)
    for text in ["licensed under the Apache License, Version 2.0", "MIT License", "CC BY-NC 4.0", "all rights reserved", "spdx license identifier mit"]:
        words = re.findall(r"[a-z0-9]+", text.lower())
        joined = " ".join(words).encode()
        plain = [(r.priority, -len(m[0].split()), i, joined.count(b" ", 0, m.start()))
                 for i, r in enumerate(made) for m in re.finditer(rb"(?<![^ ])(?:" + r.pattern.encode() + rb")(?![^ ])", joined)]
        kept = []
        for _, n, i, a in sorted(plain):
            if not any(x <= a and a - n <= y for _, x, y in kept):
                kept.append((i, a, a - n))
        assert scanner.detections(joined, {w.encode() for w in words}) == kept and kept


def test_license_containment(spark):
    df = texts_df(spark, ["Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", "mit license gpl v3"])
    got = {r.doc_id: [(d.label, d.first, d.last) for d in r.detections] for r in license.scan(df).collect()}
    assert sorted(got[0]) == [("apache-2.0", 0, 7), ("cc-by-nc-4.0", 8, 14)]
    assert {x[0] for x in got[1]} == {"mit", "gpl-3.0"}


# --- 4 --------------------------------------------------------------------

@pytest.fixture(scope="module")
def tables():
    return pieces.vocabulary()


HARD = ["".join(x) for x in (["a", " " * 9, "b "], ["\n", "\n  x"], ["\x00a\x00"], ["ab" * 60], ["привет мир 世界 𓀀 ñ"], ["é" * 40], ["  "], ["x" * 3000])]


def test_pieces_equal_the_library(spark, tables):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = sample(spark) + [(10_000 + i, t) for i, t in enumerate(EDGE + HARD)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, ids string")
    out = pieces.encode(df, tables=tables)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in rows:
        assert got[i].ids == model.encode(t or ""), repr(t)[:80]
        assert got[i].round_trip and got[i].n_tokens == len(got[i].ids)
    back = {r.doc_id: r.text for r in pieces.decode(out, tables=tables).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert pieces.encode(df.where("false"), tables=tables).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("  \n\tabcdeinorst.,É▁"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_pieces_property(tables, texts):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder = pieces.Encoder(tables)
    ids, offsets = encoder.encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [model.encode(t) for t in texts]
    data, at = encoder.decode(ids, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == [t.replace("▁", " ") for t in texts]


def test_pieces_edges_are_all_occurrences(tables):
    encoder = pieces.Encoder(tables)
    data = "the internationalization of становника".encode() + b"\x00"
    starts, found = encoder.edges(np.frombuffer(data, np.uint8))
    want = sorted((m.start(), i) for i in np.flatnonzero(tables["usable"]) for m in re.finditer(b"(?=" + re.escape(tables["surface"][i]) + b")", data))
    assert sorted(zip(starts.tolist(), found.tolist())) == want


# --- 5 --------------------------------------------------------------------

def contained(docs, items, threshold=0.8):
    def shingles(words, k):
        return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    out = set()
    for i, t in items:
        w = words(t)
        k = min(5, len(w))
        if k:
            want = shingles(w, k)
            for d, x in docs:
                n = len(want & shingles(words(x), k))
                if n >= threshold * len(want) - 1e-9:
                    out.add((d, i, len(want), n))
    return out


@pytest.mark.parametrize("max_index", [decontam.MAX_INDEX, 0])
def test_decontamination_matches_plain_version(spark, max_index):
    rng = np.random.RandomState(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, rng.randint(1, 30)))) for i in range(40)] + [(50, None), (51, ""), (52, "Solo"), (53, "two, words"), (None, "null id w1 w2 w3 w4")]
    docs = []
    for d in range(60):
        w = list(rng.choice(vocab, rng.randint(0, 80)))
        item = (items[rng.randint(45)][1] or "").split()
        if item and d % 2:      # a copy with some words changed
            for _ in range(rng.randint(0, 3)):
                item[rng.randint(len(item))] = "zz"
            w[5:5] = [x.upper() + "," for x in item]
        docs.append((d, " ".join(w)))
    docs += [(d, t) for d, t in enumerate(EDGE, 100)] + [(None, docs[1][1]), (7, docs[7][1])]
    dd = spark.createDataFrame([(*r, "q") for r in docs], "doc_id long, text string, item_id string").repartition(3)
    ii = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = {tuple(r[:4]) for r in decontam.search(dd, ii, max_index=max_index).collect()}
    assert got == contained(docs, items) and len(got) > 10
    bad = {d for d, *_ in got}
    assert sorted(map(str, (r.doc_id for r in decontam.clean(dd, ii).collect()))) == sorted(str(d) for d, _ in docs if d not in bad)
    assert decontam.search(dd.where("false"), ii, max_index=max_index).count() == 0
    assert decontam.search(dd, ii.where("false"), max_index=max_index).count() == 0


def test_sketch_never_misses():
    """Whichever shingles a contained item misses, its sketch keeps enough hits."""
    for n in range(1, 200):
        r = decontam.sketch_length(n, 0.8)
        missing = n - decontam._need(n, 0.8)
        assert missing < r <= n and r - missing >= 1


# --- 7 --------------------------------------------------------------------

def test_language_vectors_match_plain_version(monkeypatch):
    table, space = hdlang.letter_table(), hdlang.Space(64)
    texts = ["Abc abc!", "", "12 34", "É a", None, "ab  cd " * 5]
    monkeypatch.setattr(hdlang, "PIECE", 7)
    got = space.bundle([t or "" for t in texts], table)
    for t, v in zip(texts, got):
        s = " " + re.sub(r"[\W\d_]+", " ", " " + (t or "").lower() + " ").strip() + " "
        want = np.zeros(64)
        if s.strip():
            for a, b, c in zip(s, s[1:], s[2:]):
                want += np.roll(space.letter(ord(a)), 2) * np.roll(space.letter(ord(b)), 1) * space.letter(ord(c))
        assert np.array_equal(v, want), t


def test_language_held_out_accuracy(spark):
    docs = textops.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(0, "the cat and the dog", "en"), (1, "le chat et le chien", "fr"), (2, None, "en"), (3, "123 ...", "en"), (4, "", None),
            (5, "the dog and the cat", None), (None, "le chien et le chat", "fr"), (7, "日本", None), (8, "the cat" * 3000, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in hdlang.identify(df, F.coalesce(F.col("doc_id") != 7, F.lit(True))).collect()}
    assert [got[i][0] for i in (0, 1, 2, 3, 4, 5, None, 8)] == ["en", "fr", "und", "und", "und", "en", "fr", "en"]
    assert got[2][1] == 0 and got[7][0] in ("en", "fr")
    assert {r.lang_pred for r in hdlang.identify(df, F.lit(False)).collect()} == {"und"}
    assert hdlang.identify(df.where("false"), F.lit(True)).count() == 0


# --- 8 --------------------------------------------------------------------

def chat_expected(turns):
    turns = [(r or "", t or "") for r, t in turns]
    learned = [t for r, t in turns if r == "assistant"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, learned)), sha("".join(learned)), sum(len(chat.segment(r, t)[0]) for r, t in turns))


def test_chat_query_has_the_extra_conversation(spark):
    got = {r.conv_id: tuple(r[1:]) for r in queries.op8_chat_format(spark, SF).collect()}
    rows = {}
    for r in textops.table(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    rows[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    assert got == {c: chat_expected(t) for c, t in rows.items()}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<>/turn assi\n", max_size=30), st.text(alphabet="\\<>/turn x\n", max_size=40))
def test_chat_template_is_reversible(role, text):
    made, a, b = chat.segment(role, text)
    assert chat.read(made) == (role, text)
    assert chat.unescape(made[a:b]) == text
    assert made.count("</turn>\n") - made.count("\\</turn>\n") == 1 or "\\" in role + text


def test_chat_layouts_give_the_same_turns(spark):
    u, a, s = "a question", "an answer", "be brief"
    records = [{"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": a}], "id": 3},
               {"conversations": [{"from": "human", "value": u}, {"from": "gpt", "value": a}]}, {"instruction": u, "output": a},
               {"prompt": u, "completion": a}, {"prompt": u, "response": a, "id": "x"}, {"question": u, "answer": a}, {"data": {"prompt": u, "response": a}},
               {"instruction": "a", "input": "question", "output": a, "system": s}, {"unknown": 1}, [1], "text", {}]
    df = spark.createDataFrame([(i, 0, json.dumps(r), "y") for i, r in enumerate(records)] + [(90, 0, None, "y"), (91, 0, "{bad", "y")],
                               "conv_id long, turn long, record string, layout string")
    got = {}
    for r in chat.canonical(df).orderBy("conv_id", "pos").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(got[i] == [("user", u), ("assistant", a)] for i in range(7))
    assert got[7] == [("system", s), ("user", "a\nquestion"), ("assistant", a)]
    assert all(got[i] == [(None, None)] for i in (8, 9, 10, 11, 90, 91))


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "n"), (2, None, "assistant", "b"), (2, 5, "assistant", "c"), (3, 0, "a>\\", "</turn>"), (3, 0, "a>\\", "</turn>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    run = lambda x: {r.conv_id: tuple(r[1:]) for r in chat.read_back(chat.format_turns(chat.canonical(x))).collect()}
    assert run(records) == {1: chat_expected([("user", ""), ("", "x")]), None: chat_expected([("assistant", "n")]),
                            2: chat_expected([("assistant", "b"), ("assistant", "c")]), 3: chat_expected([("a>\\", "</turn>")] * 2)}
    assert run(records.where("false")) == {}
