"""Operators 11 to 13 against plain versions, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postline.llm import queries, textops, variants, wavelet, whitening

SF = "/root/testdata/sf0.001"
TOKENIZER = queries.tokenizer_path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t", "a", "É été <|endoftext|> x<|startoftext|>y", "it's we'll\x1cdon't 123 ...!?", "日本 語 wide space", "é ́x ΣΑΣ",
         "word " * 3000, "same text", "same text", "x" * 9000, "\x00 \x00"]


# --- 11 -------------------------------------------------------------------

@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300), st.randoms(use_true_random=False))
def test_shard_answers_like_a_list(tmp_path_factory, values, r):
    """access, count, select, occurrences and the whole, on blocks of 32 bits."""
    ids = np.array(values, np.uint32)
    wavelet.BLOCK, whole = 32, wavelet.BLOCK
    try:
        path = tmp_path_factory.mktemp("shard") / "x.wm"
        path.write_bytes(wavelet.pack(ids, np.array([len(ids) // 2, len(ids)]), [None, -5]))
        shard = wavelet.Shard(str(path))
    finally:
        wavelet.BLOCK = whole
    assert shard.tokens().tolist() == values and shard.doc_ids == [None, -5] and shard.ends.tolist() == [len(ids) // 2, len(ids)]
    for i in r.sample(range(len(values)), min(10, len(values))):
        token, a, b = values[i], *sorted((r.randint(0, len(values)), r.randint(0, len(values))))
        places = [k for k, v in enumerate(values) if v == token]
        assert shard.access(i) == token and shard.count(token, a, b) == sum(a <= p < b for p in places)
        assert list(shard.occurrences(token, a, b)) == [p for p in places if a <= p < b]
        assert [shard.select(token, k) for k in range(len(places))] == places
    assert shard.count(1 << 30) == 0 and shard.count(-1) == 0
    for wrong in (-1, len(values)):
        with pytest.raises(IndexError):
            shard.access(wrong)


def model():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(TOKENIZER)


def test_words_encode_as_texts_do(spark):
    """White space never changes what a word's ids are."""
    tk, encoder = model(), wavelet.Encoder(TOKENIZER)
    texts = TEXTS + ["L'ÉTÉ's 'Tis I'LL 'sup x'd \"'s ''re 12a3 __ a_b", "ÀÿÖ×÷ß", "µ ª\xa0b\x85c", "<|ENDOFTEXT|> <|endoftext|>.", "e\u0301 E\u0301 \u212bngström", "don’t “q” – x…"]
    texts += [r.text for r in textops.table(spark, SF, "documents").select("text").collect()]
    want = [tk.encode(t or "", add_special_tokens=False).ids for t in texts]
    for memo in (wavelet.MEMO, 5):
        wavelet.MEMO, whole = memo, wavelet.MEMO
        try:
            ids, count = encoder.encode(*textops.text_bytes(pa.array(texts)))
        finally:
            wavelet.MEMO = whole
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abzAZ'srvemltd 09\n\t.,-_<|>\x1c\x00éÉ×÷ßÿ\xa0\u0301’日", max_size=40), max_size=4))
def test_any_text_encodes_as_the_tokenizer_does(texts):
    if not hasattr(test_any_text_encodes_as_the_tokenizer_does, "both"):
        test_any_text_encodes_as_the_tokenizer_does.both = model(), wavelet.Encoder(TOKENIZER)
    tk, encoder = test_any_text_encodes_as_the_tokenizer_does.both
    ids, count = encoder.encode(*textops.text_bytes(pa.array(texts, pa.string())))
    assert ids.tolist() == [i for t in texts for i in tk.encode(t, add_special_tokens=False).ids]
    assert count.tolist() == [len(tk.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("shard_tokens", [wavelet.SHARD_TOKENS, 500])
def test_wavelet_round_trip(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(wavelet, "MEMO", 3 if shard_tokens == 500 else wavelet.MEMO)
    rows = [(i - 3, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, "no id"), (4, "again"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, path string, start int").repartition(3)
    manifest = wavelet.write(docs, TOKENIZER, shard_tokens=shard_tokens)
    assert manifest.count() > (1 if shard_tokens == 500 else 0)
    got = [tuple(r) for r in wavelet.read_back(manifest).orderBy("start").collect()]
    tk, at = model(), 0
    encoded = defaultdict(list)
    for i, t in rows:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        encoded[i].append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    for i, start, n, crc in got:
        assert start == at and (n, crc) in encoded[i]
        encoded[i].remove((n, crc))
        at += n
    assert not any(encoded.values())


def test_wavelet_lookups(spark):
    docs = textops.table(spark, SF, "documents")
    manifest = wavelet.write(docs, TOKENIZER, shard_tokens=20_000)
    tk, ids, begin = model(), [], {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        begin[r.doc_id] = len(ids)
        ids += [*tk.encode(r.text or "", add_special_tokens=False).ids, 2]
    ids = np.array(ids)
    asked = [2, int(ids[0]), int(ids[-5]), 49_000]
    assert {tuple(r) for r in wavelet.counts(manifest, asked).collect()} == {(t, int((ids == t).sum())) for t in asked}
    found = wavelet.lookup(manifest, asked).collect()
    assert sorted((r.token, r.place) for r in found) == sorted((t, int(p)) for t in asked for p in np.flatnonzero(ids == t))
    assert all(begin[r.doc_id] + r.offset == r.place for r in found)
    places = [0, 1, len(ids) - 1, len(ids), -1, len(ids) // 2, len(ids) // 2]
    got = wavelet.access(manifest, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    assert sorted(map(tuple, got)) == sorted((p, int(ids[p])) for p in places if 0 <= p < len(ids))
    # a lookup reads a small part of a file
    path = max(manifest.collect(), key=lambda r: r.n_tokens).path
    shard = wavelet.Shard(path)
    shard.access(5)
    assert len(shard.kept) <= shard.bits


def test_wavelet_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = wavelet.write(docs, TOKENIZER)
    assert manifest.count() == 0 and wavelet.read_back(manifest).count() == 0 and wavelet.counts(manifest, [1]).count() == 0


def test_wavelet_query(spark):
    tk, at, want = model(), 0, []
    for r in textops.table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op11_wavelet_shards(spark, SF).collect())) == want


# --- 12 -------------------------------------------------------------------

def variants_plain(rows, min_chars=5, min_count=3):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= min_chars:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= min_count}
    near = {w: {v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)} for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1:]


@pytest.mark.parametrize("seed,letters", [(0, "ab"), (1, "abé"), (2, "abcdeÀ÷")])
def test_variants_match_plain_version(spark, seed, letters):
    """Few letters: bigrams that repeat, tie and overlap; chains of forms."""
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(250)]
    words += [w[:k] + r.choice(letters) + w[k + r.randint(0, 1):] for w in words for k in [r.randint(0, len(w))]]
    weights = [3 ** r.randint(0, 5) for _ in words]
    rows = [(i, r.choice([" ", "-", "9\n"]).join(r.choices([w if r.random() < .8 else w.upper() for w in words], weights, k=300))) for i in range(40)]
    rows += [(None, rows[0][1]), (None, None), (7, ""), (7, rows[7][1])] + [(100 + k, "a" * 5000 + " " + "a" * 4999) for k in range(4)]
    df = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = [tuple(x) for x in variants.group(df).collect()]
    want = variants_plain(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(x[1] != x[2] and x[1] for x in want)


def test_pivots_are_the_rarest_disjoint_pair():
    r = np.random.RandomState(3)
    letters = r.randint(0, 4, (200, 7))
    grams = variants.bigrams(letters)
    count = r.randint(1, 50, variants.LETTERS ** 2)
    rank = np.empty(len(count), np.int64)
    rank[np.lexsort([np.arange(len(count)), count])] = np.arange(len(count))
    inside, last = variants.prefix(grams, rank)
    chosen = variants.pivots(grams, inside, count)
    for g, keep, end, (a, b) in zip(grams, inside, last, chosen):
        assert sorted(rank[g])[2] == end and keep.sum() >= 3 and b - a >= 2 and keep[a] and keep[b]
        pairs = [count[g[i]] + count[g[j]] for i in np.flatnonzero(keep) for j in np.flatnonzero(keep) if j - i >= 2]
        assert count[g[a]] + count[g[b]] == min(pairs)


def test_variants_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "ab cd"), (3, "longer words once")], "doc_id long, text string")
    assert variants.group(docs).count() == 0 and variants.group(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        variants.group(docs, min_chars=3)


# --- 13 -------------------------------------------------------------------

def whitening_plain(vectors, count=4):
    """Rows (position of the vector, component, deviation, whitened, explained), signs free."""
    x = np.floor(256 * np.array(vectors, float))
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(len(sums), -1))
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, [((x - sums / n) @ axes[:, c] / np.sqrt(values[c]), values[c] / values.sum()) for c in range(min(count, len(sums)))]


@pytest.mark.parametrize("rows", [whitening.ROWS, 7])
def test_whitening_matches_plain_version(spark, monkeypatch, rows):
    """Small blocks: many of them, in several tasks; copies, nulls and infinite entries."""
    monkeypatch.setattr(whitening, "ROWS", rows)
    monkeypatch.setattr(whitening, "COLUMNS", 1024 if rows > 7 else 3)
    rng = np.random.RandomState(5)
    good = rng.randn(60, 5) @ rng.randn(5, 5)
    good = np.concatenate([good, good[:1].repeat(40, 0), good[:9], good[3:4] + 1e-9])
    named = [(int(i) if i % 11 else None, v.tolist()) for i, v in enumerate(good)]
    bad = [(1, None), (2, [1.0, 2.0, None, 3.0, 4.0]), (3, [float("nan")] * 5), (4, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (5, []), (6, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in named + bad], "vec_id long, embedding array<double>, component string, n int").repartition(5)
    got = whitening.whiten(df).toPandas()
    n, deviation, parts = whitening_plain(good)
    assert len(got) == 4 * len(good) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert Counter(got.vec_id.dropna().astype(int)) == Counter({k: 4 * v for k, v in Counter(i for i, _ in named if i is not None).items()})
    for c, (white, share) in enumerate(parts, 1):
        mine = got[got.component == c]
        assert mine.explained.values == pytest.approx(share, rel=1e-9)
        best = min(sum(abs(a - b) + (d != e) for (d, a), (e, b) in zip(sorted(zip(mine.deviation, sign * mine.whitened)), sorted(zip(deviation, white)))) for sign in (1, -1))
        assert best < 1e-6


def test_whitening_of_few_vectors(spark):
    def of(vectors):
        return whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")).collect()
    assert of([]) == [] and of([None, []]) == [] and of([[1.0, 2.0]] * 5) == []
    two = of([[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]])          # one component has a variance
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two) == [
        (i, 1, 2, 256 ** 2 + 512 ** 2, 1.0, 1.0) for i in range(3)]
    huge = of([[1e30, 0.0], [0.0, 1.0], [0.5, 0.5]])
    assert all(r.deviation is None for r in huge)


def test_whitening_query(spark):
    table = textops.table(spark, SF, "embeddings").orderBy("vec_id").toPandas()
    n, deviation, parts = whitening_plain(table.embedding.tolist())
    got = queries.op13_embedding_whitening(spark, SF).toPandas()
    assert len(got) == 4 * len(table)
    for c, (white, share) in enumerate(parts, 1):
        mine = got[got.component == c].sort_values("vec_id")
        assert mine.vec_id.tolist() == table.vec_id.tolist() and mine.deviation.tolist() == deviation and set(mine.n) == {n}
        assert min(np.abs(mine.whitened.values - s * white).max() for s in (1, -1)) < 1e-9
        assert np.allclose(mine.explained, share, rtol=1e-9) and mine.identity_error.max() < 1e-9
