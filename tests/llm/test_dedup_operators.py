"""Operators 6, 9 and 10 and the pipeline against plain versions, and their edge cases."""

import hashlib
import importlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postline.llm import decontam, graph, jaccard, passages, quality, queries, stages, suffix, textops

SF = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return [w for w in re.split(SPACE, t or "") if w]


def sample(spark):
    return [tuple(r) for r in textops.table(spark, SF, "documents").select("doc_id", "text", "lang", "source").collect()]


# --- 6 --------------------------------------------------------------------

def cut_plain(texts, length):
    """Mask of removed bytes for each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[p:p + length] for x in raw for p in range(len(x) - length + 1))
    masks = []
    for x in raw:
        mask = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p:p + length]] > 1:
                mask[p:p + length] = b"\x01" * length
        masks.append(mask)
    return raw, masks


def digest(raw, mask):
    kept = bytes(b for b, m in zip(raw, mask) if not m)
    return (len(raw), sum(mask), sum(1 for i in range(len(mask)) if mask[i] and (not i or not mask[i - 1])), hashlib.sha256(kept).hexdigest())


def small_texts(seed):
    r = random.Random(seed)
    common = ["".join(r.choice("abé") for _ in range(r.randint(15, 60))) for _ in range(4)]
    texts = ["".join(r.choice(common) if r.random() < .4 else "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 25)))
                     for _ in range(r.randint(1, 6))) for _ in range(60)]
    return texts + [None, "", "a" * 100, "ab" * 40, texts[0], texts[0], "x" * 19]


@pytest.mark.parametrize("seed,group", [(0, 2), (1, 20_000), (2, 2)])
def test_suffix_dedup_matches_plain_version(spark, monkeypatch, seed, group):
    """Group 2 sends nearly all grams through the bands of offsets."""
    monkeypatch.setattr(suffix, "BANDS", (4, 2, 1))
    texts = small_texts(seed)
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, t string").repartition(3)
    got = {r[0]: tuple(r[1:5]) for r in suffix.report(df, length=20, gram=6, group=group, bucket_rows=25).collect()}
    assert got == {i: digest(*x) for i, x in enumerate(zip(*cut_plain(texts, 20)))}


def test_suffix_dedup_real_length(spark):
    rows = sample(spark)
    got = {r.doc_id: tuple(r[1:]) for r in queries.op6_suffix_dedup(spark, SF).collect()}
    want = {r[0]: digest(*x) for r, x in zip(rows, zip(*cut_plain([r[1] for r in rows], 400)))}
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_suffix_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suffix, "MAX_IDS", 0)
    monkeypatch.setattr(suffix, "MAX_GRAMS", 0)
    texts = small_texts(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r[0]: tuple(r[1:5]) for r in suffix.report(df, length=20, gram=6).collect()}
    assert got == {i: digest(*x) for i, x in enumerate(zip(*cut_plain(texts, 20)))}


def test_suffix_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 700)
    monkeypatch.setattr(textops, "SLICE_BYTES", 1000)
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh") for _ in range(90))
    long = "".join(r.choice("abcdefgh") for _ in range(1500)) + passage + "".join(r.choice("abcdefgh") for _ in range(660)) + passage
    texts = [long, "x" + passage + "y", "zz" * 20]
    monkeypatch.setattr(textops.slices, "__defaults__", (1000,))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r[0]: tuple(r[1:5]) for r in suffix.report(df, length=40, gram=12).collect()}
    assert got == {i: digest(*x) for i, x in enumerate(zip(*cut_plain(texts, 40)))}


def test_suffix_dedup_keeps_rows_columns_and_ids(spark):
    p = "é" * 8 + "abcdefghijklmnopqrstuv" * 2
    rows = [(1, "eins " + p, "de", 0), (None, "zwei " + p, None, 1), (None, "zwei " + p, None, 2), (4, None, "x", 3), (5, "", "y", 4), (1, "kurz", "z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans string, _text_name int")
    got = sorted((tuple(r) for r in suffix.dedup(df, length=20, gram=6).collect()), key=lambda r: r[3])
    raw, masks = cut_plain([r[1] for r in rows], 20)
    for (i, t, c, k), g, x, m in zip(rows, got, raw, masks):
        assert (g[0], g[2], g[3]) == (i, c, k)
        assert g[1] == (t if not any(m) else bytes(b for b, f in zip(x, m) if not f).decode("utf-8", "ignore"))
    assert suffix.report(df.where("false"), length=20, gram=6).count() == 0
    assert suffix.dedup(df.where("false")).count() == 0


def words_plain(texts, n):
    """Byte masks of the words that a repeated run of n words covers."""
    found = [[(m.group(), *m.span()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", (t or "").encode())] for t in texts]
    seen = Counter(tuple(w[0] for w in x[i:i + n]) for x in found for i in range(len(x) - n + 1))
    masks = []
    for t, x in zip(texts, found):
        mask = bytearray(len((t or "").encode()))
        for i in range(len(x) - n + 1):
            if seen[tuple(w[0] for w in x[i:i + n])] > 1:
                mask[x[i][1]:x[i + n - 1][2]] = b"\x01" * (x[i + n - 1][2] - x[i][1])
        masks.append(mask)
    return masks


@pytest.mark.parametrize("seed,piece", [(0, 300_000), (1, 40)])
def test_repeated_words_match_plain_version(spark, monkeypatch, seed, piece):
    r = random.Random(seed)
    common = [[r.choice("aé b c dd e".split()) + str(r.randint(0, 9)) for _ in range(r.randint(6, 30))] for _ in range(5)]
    texts = [r.choice([" ", "\n "]).join(sum((r.choice(common)[r.randint(0, 3):] if r.random() < .5 else [f"w{r.randint(0, 30)}" for _ in range(r.randint(1, 9))]
                                             for _ in range(r.randint(1, 6))), [])) for _ in range(80)]
    texts += [None, "", "a " * 40, "a b " * 9, texts[0], texts[0]]
    if piece < 100:     # pieces are for texts that are alone in their slice
        monkeypatch.setattr(passages, "PIECE", piece)
        monkeypatch.setattr(textops.slices, "__defaults__", (1,))
        monkeypatch.setattr(passages, "MAX_IDS", 0)
        monkeypatch.setattr(passages, "MAX_GRAMS", 0)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spans = {x.t: suffix.merged(x.spans) for x in passages.covered(df, words=12, gram=5).collect()}
    got = {x.doc_id: spans.get(x.t, []) for x in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    for i, mask in enumerate(words_plain(texts, 12)):
        have = bytearray(len(mask))
        for a, b in got[i]:
            have[a:b] = b"\x01" * (b - a)
        assert have == mask, (i, texts[i])


def test_stage_cuts_all_passages_of_over_50_words(spark):
    rng = np.random.RandomState(5)
    vocab = [f"{a}{b}" for a in "bdfgklmn" for b in ("a", "e", "io", "u")]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    rows, planted = [], {}
    for n in (40, 50, *range(51, 61)):
        passage = prose(n)
        for side in range(2):   # the words around the passage differ, so it isn't longer than meant
            before, after = prose(70) + f" x{n}{side}", f"y{n}{side} " + prose(70)
            planted[len(rows)] = (n, passage, before, after)
            rows.append((len(rows), f"{before} {passage} {after}"))
    assert len(planted[22][1]) < 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in stages.suffix_dedup(spark, docs, SF).collect()}
    for i, (n, passage, before, after) in planted.items():
        assert got[i] == (f"{before}  {after}" if n > 50 else rows[i][1]), n


def test_multikey_quicksort_and_buckets():
    rng = np.random.RandomState(0)
    words_ = rng.randint(0, 3, (3000, 5)).astype(np.uint64)
    order = suffix.multikey_quicksort(words_)
    assert [tuple(w) for w in words_[order]] == sorted(tuple(w) for w in words_)
    lead, g = rng.randint(0, 50, 4000), rng.randint(-9, 9, 4000)
    cuts = np.array([5, 10, 10, 10, 40])
    at = suffix.bucket_of(lead, g, cuts, 3)
    assert at.min() >= 0 and at.max() < 18
    assert all(len(set(at[(lead == a) & (g == b)])) == 1 for a, b in {*zip(lead.tolist(), g.tolist())})
    ranges = at // 3
    assert all(ranges[lead < 5] == 0) and all(ranges[lead > 40] == 5) and len(set(ranges[lead == 10])) > 1


# --- 9 --------------------------------------------------------------------

def statistics_plain(t):
    w = words(t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n)


EDGE = [None, "", " \n ", "a b c a b c", "a a a a", "x", "é é é\né é é\n\né é é", "# | <> \x0b*", "w " * 3000, "\n".join(["line one"] * 40)]


def test_quality_statistics_match_plain_version(spark):
    rows = [r[:2] for r in sample(spark)] + [(10_000 + i, t) for i, t in enumerate(EDGE)]
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, x0 int")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == statistics_plain(t), repr(t)[:60]
        assert not (r.base_failed and r.kept)
    assert quality.judge(df.where("false")).count() == 0


def mcd_plain(x):
    """Center, covariance and scale, by the operator's steps."""
    def quantile(v, q):
        v = np.sort(v)
        return v[max(0, int(np.ceil(q * len(v))) - 1)]

    floor = np.array(quality.FLOOR)

    def distance(m, c):
        factor = np.linalg.cholesky(c + np.diag(floor ** 2))
        y = np.linalg.solve(factor, (x - m).T)
        return (y * y).sum(0)

    m = np.array([quantile(x[:, i], 0.5) for i in range(x.shape[1])])
    c = np.diag([(1.4826 * quantile(np.abs(x[:, i] - m[i]), 0.5)) ** 2 for i in range(x.shape[1])])
    for _ in range(quality.STEPS):
        d = distance(m, c)
        near = x[d <= quantile(d, quality.COVERAGE)]
        m, c = near.mean(0), np.cov(near.T, bias=True)
    d = distance(m, c)
    return d / max(1.0, quantile(d, 0.5) / quality.CHI2_MEDIAN)


def test_mcd_matches_numpy(spark):
    rng = np.random.RandomState(1)
    x = np.concatenate([rng.multivariate_normal([1, 2, 3, 4], np.eye(4) * .2 + .1, 400), rng.normal(9, 1, (60, 4))])
    rows = [("en", "a", *map(float, r)) for r in x] + [("fr", "b", *map(float, r)) for r in x[:20] + 50]
    vectors = spark.createDataFrame(rows, "g_lang string, g_source string, x0 double, x1 double, x2 double, x3 double")
    model = quality.estimates(vectors)
    got = vectors.where("g_lang = 'en'").join(model, ["g_lang", "g_source"]).select("x0", (quality._square_distance() / F.col("s")).alias("d")).collect()
    want = dict(zip(x[:, 0], mcd_plain(x)))
    assert len(got) == len(x)
    assert all(abs(r.d - want[r.x0]) <= 1e-6 * max(1, want[r.x0]) for r in got)
    assert sum(r.d > quality.CUTOFF for r in got) == 60
    cells = {(r.g_lang, r.g_source): r.cell for r in quality._cells(vectors, 100).collect()}
    assert cells[("en", "a")] == '{"g_lang":"en","g_source":"a"}' and cells[("fr", "b")] == "{}"


def test_quality_rejects_junk_and_keeps_clean(spark):
    docs = textops.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    rows = docs.collect()
    junk = [r.doc_id for r in rows if not got[r.doc_id].base_failed and got[r.doc_id].n_symbols > got[r.doc_id].n_words]
    plain = [r.doc_id for r in rows if not got[r.doc_id].base_failed and got[r.doc_id].n_symbols * 20 < got[r.doc_id].n_words and got[r.doc_id].n_dup_lines < 2]
    assert len(junk) > 10 and not any(got[i].kept for i in junk)
    assert sum(not got[i].kept for i in plain) <= len(plain) * 0.002
    assert {r.doc_id for r in quality.clean(docs).collect()} == {i for i, r in got.items() if r.kept}


# --- 10 -------------------------------------------------------------------

def jaccard_plain(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else min(least[r], d) if d is not None else least[r]
    return [(d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)]


def near_copies(seed):
    rng = np.random.RandomState(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = list(rng.choice(vocab, rng.randint(1, 200)))
        for _ in range(rng.randint(1, 12)):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randint(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    hot = list(rng.choice(vocab, 300))
    for k in range(90):     # more than a bucket
        copy = list(hot)
        copy[rng.randint(300)] = f"x{k % 30}"
        rows.append((len(rows), " ".join(copy).upper()))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE\ttwo"), (505, "two one"), (None, "one two"), (7, rows[7][1])]


@pytest.mark.parametrize("seed,bucket,block", [(0, 64, 512), (1, 8, 16)])
def test_jaccard_join_matches_plain_version(spark, monkeypatch, seed, bucket, block):
    """Small buckets force splits down to the last level, small blocks force block pairs."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "MAX_IDS", 500_000 if seed else 0)
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, node string").repartition(3)
    got = [tuple(r) for r in jaccard.join(df).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(jaccard_plain(rows), key=key)


def test_jaccard_family_over_a_chain_of_anchors(spark):
    """Halves linked to the ends of a chain of anchors are one family; a bucket without links is not settled."""
    links = [(4, 1), (4, 0), (5, 2), (5, 1), (6, 3), (6, 2)] + [(i, 3 * (i % 2)) for i in range(7, 80)]
    large = spark.createDataFrame([(1, i, 80) for i in range(80)] + [(2, i, 90) for i in range(100, 190)], "path long, node long, n long")
    rest, left = jaccard._by_family(large, spark.createDataFrame(links, "a long, b long"))
    assert rest.count() == 0 and {r.path for r in left.collect()} == {2} and left.count() == 90


def test_jaccard_dedup_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "x y z"), (5, None), (6, ""), (2, "x y z"), (9, "a b c d e f g")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, class_id string")
    assert sorted(r.doc_id for r in jaccard.dedup(df).collect()) == [1, 2, 5, 6]
    assert jaccard.join(df.where("false")).count() == 0 and jaccard.dedup(df.where("false")).count() == 0


def test_runs_reach_the_target_recall():
    rng = np.random.RandomState(2)
    runs, found, pairs = jaccard.runs_needed(), 0, 300
    for _ in range(pairs):     # pairs that agree in exactly four fifths of their tokens
        a = rng.randint(0, 2 ** 31, jaccard.COORDS).astype(np.uint32)
        b = a.copy()
        b[rng.permutation(jaccard.COORDS)[:jaccard.COORDS // 5]] += 1
        roots = textops.mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        paths = [set(jaccard.split(roots, np.zeros(runs, np.int64), x[None, :], jaccard.LEVELS, 0.8)[0].tolist()) for x in (a, b)]
        found += bool(paths[0] & paths[1])
    assert found >= 0.97 * pairs


def test_pairs_of_a_family_are_found_below_the_first_split(spark):
    """Pairs at 0.8 in a family of similarity 0.5, whose buckets are split down to the last level."""
    rng = np.random.RandomState(4)
    pairs, shared = 300, rng.randint(0, 2 ** 31, jaccard.COORDS)
    rows = []
    for k in range(pairs):     # a hash is the family's with 0.7, so two texts agree in about a half
        a = np.where(rng.random_sample(jaccard.COORDS) < 0.7, shared, rng.randint(0, 2 ** 31, jaccard.COORDS)).astype(np.uint32)
        b = np.where(rng.random_sample(jaccard.COORDS) < 0.8, a, rng.randint(0, 2 ** 31, jaccard.COORDS)).astype(np.uint32)
        rows += [(2 * k, bytearray(a.tobytes())), (2 * k + 1, bytearray(b.tobytes()))]
    nodes = spark.createDataFrame(rows, "node long, tokens binary")
    found = {frozenset(r) for r in jaccard._likely(_deepest(nodes), nodes, 0.8).collect()}
    assert sum(frozenset((2 * k, 2 * k + 1)) in found for k in range(pairs)) >= 0.97 * pairs


def _deepest(nodes):
    """Members of the paths of the last level."""
    paths = jaccard._first_paths(nodes, jaccard.runs_needed(), 0.8)
    for _ in range(2 * jaccard.LEVELS, jaccard.MAX_LEVELS + 1, jaccard.LEVELS):
        paths = jaccard._next_paths(jaccard._shared(paths), nodes, 0.8)
    return jaccard._shared(paths)


def test_intersections():
    rng = np.random.RandomState(3)
    sets = [np.unique(rng.randint(0, 60, rng.randint(1, 50))).astype(np.uint64) for _ in range(20)] + [np.zeros(0, np.uint64)]
    got = jaccard.intersections(sets)
    assert all(got[i, j] == len(set(a.tolist()) & set(b.tolist())) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pipeline -------------------------------------------------------------

def test_pipeline_stages_have_their_effect(spark):
    """Each stage on documents with a known fate; then the whole chain."""
    rng = np.random.RandomState(8)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    item = textops.table(spark, SF, "benchmark").orderBy(F.length("text").desc()).first().text
    clean = {i: prose(120) for i in range(99)} | {i: prose(120) for i in range(200, 230)}
    near = clean[3].split()
    near[50] = "changed"
    passage = prose(130)
    rows = dict(clean)
    rows |= {100: "too short", 101: "same three words " * 60, 102: " ".join(w + "***###" for w in prose(100).split()), 103: " ".join(near), 104: clean[5],
             105: prose(80) + " " + passage, 106: passage + " " + prose(80), 107: prose(60) + " " + item + " " + prose(60), 108: None}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long, _drop string")
    kept = docs
    for name, stage in stages.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
    left = {r.doc_id: r for r in kept.collect()}
    assert set(left) == set(clean) | {105, 106}
    assert all(passage[50:-50] not in left[i].text for i in (105, 106)) and left[105].n_chars == len(left[105].text) < 120 * 5
    assert all(left[i].text == clean[i] for i in clean)
    last = {r.doc_id: r for r in stages.STAGES[-1][1](spark, kept, SF).collect()}
    assert set(last) == set(left) and all(r.round_trip and r.n_tokens > 0 for r in last.values())


def test_pipeline_query_matches_plain_version(spark):
    """The registered query against the plain versions of its stages, one after another (quality by the operator's own query)."""
    import corpus_pipeline
    rows = {r[0]: r[1] for r in sample(spark)}
    kept = {r.doc_id for r in quality.judge(textops.table(spark, SF, "documents")).where("kept").collect()}
    rows = {i: t for i, t in rows.items() if i in kept}
    rows = {i: rows[i] for i, least, _ in jaccard_plain(list(rows.items())) if i == least}
    raw, masks = cut_plain(list(rows.values()), 400)
    masks = [bytes(a | b for a, b in zip(m, w)) for m, w in zip(masks, words_plain(list(rows.values()), 51))]
    rows = {i: t if not any(m) else bytes(b for b, f in zip(x, m) if not f).decode("utf-8", "ignore") for (i, t), x, m in zip(rows.items(), raw, masks)}
    items = [tuple(r) for r in textops.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    shingles = {i: decontam.item_shingles(t, 5) for i, t in items}
    bad = set()
    for d, t in rows.items():
        w = [x for x in decontam.plain_words(t) if x]
        bad |= {d for width, want in shingles.values() if want and len(want & decontam.shingle_set(w, width)) >= 0.8 * len(want) - 1e-9}
    import sentencepiece
    from postline.llm import pieces
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: model.encode(t) for i, t in rows.items() if i not in bad} and bad


def test_suffix_report_tells_repeated_words(spark):
    """Columns behind the contract: bytes in repeated runs of over 50 words, shorter or longer than 400 bytes."""
    rows = [tuple(r) for r in textops.table(spark, SF, "documents").select("doc_id", "text").collect()]
    df = textops.table(spark, SF, "documents")
    got = {r.doc_id: (r.n_passage_bytes, r.in_passage) for r in suffix.report(df).collect()}
    want = {i: (sum(m), any(m)) for (i, _), m in zip(rows, words_plain([t for _, t in rows], 51))}
    assert got == want and any(v for _, v in got.values())


def test_suffix_stage_matches_plain_version_with_words(spark):
    """On documents of over 50 parts: windows of 400 bytes and runs of over 50 words."""
    docs = textops.table(spark, SF, "documents").where(F.size(F.split("text", " ")) > 50)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    raw, masks = cut_plain([t for _, t in rows], 400)
    more = words_plain([t for _, t in rows], 51)
    want = {i: bytes(b for b, f, g in zip(x, m, w) if not f and not g).decode("utf-8", "ignore") if any(m) or any(w) else t
            for (i, t), x, m, w in zip(rows, raw, masks, more)}
    assert {r.doc_id: r.text for r in stages.suffix_dedup(spark, docs, SF).collect()} == want
    assert any(any(g and not f for f, g in zip(m, w)) for m, w in zip(masks, more))


def test_stages_judge_rows_not_ids(spark):
    """Null and repeated ids with different texts: only the rows that are meant go."""
    rng = np.random.RandomState(9)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    item = textops.table(spark, SF, "benchmark").orderBy(F.length("text").desc()).first().text
    ids = [None] * 5 + [7] * 5 + list(range(20, 26))
    clean = [(i, prose(120), f"clean{k}") for k, i in enumerate(ids)]
    near = lambda k: " ".join(["changed", *clean[k][1].split()[1:]])

    def stays(stage, bad):
        rows = [(i, t, "en", "s", n) for i, t, n in clean + bad]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _drop0 string").repartition(3)
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        return sorted((r.doc_id or 0, r.text or "", r._drop0) for r in out.collect())

    want = sorted((i or 0, t, n) for i, t, n in clean)
    short = [(None, "too short", "q"), (7, "short too", "q"), (20, "", "q"), (None, None, "q")]
    assert stays(stages.quality_rules, short) == want
    leak = [(i, prose(60) + " " + item + " " + prose(60), "d") for i in (None, 7, 21)]
    assert stays(stages.decontamination, leak) == want
    copies = [(None, near(15), "j"), (25, near(14), "j"), (None, clean[10][1], "j"), (7, clean[5][1], "j"), (None, clean[0][1], "j")]
    empty = [(None, None, "e1"), (None, None, "e2"), (7, "", "e3"), (7, "", "e4")]
    assert stays(stages.jaccard_join, copies + empty) == sorted(want + [(i or 0, t or "", n) for i, t, n in empty])


def test_entry_registers_all(spark):
    entry = importlib.import_module("__spark_entry__")
    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline", n)]
    assert sorted(names, key=lambda n: int((re.findall(r"\d+", n) or [99])[0])) == [
        "op1_brown_scores", "op2_url_filter", "op3_license_scan", "op4_sentencepiece", "op5_decontamination", "op6_suffix_dedup", "op7_language_id",
        "op8_chat_format", "op9_quality_rules", "op10_jaccard_join", "op11_wavelet_shards", "op12_spelling_variants", "op13_embedding_whitening", "pipeline"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["op2_url_filter", "op5_decontamination", "op8_chat_format", "op12_spelling_variants"])
def test_oracles(spark, name):
    import oracle_harness
    result = oracle_harness.compare(spark, oracle_harness.duck(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert result["ok"], result
