"""Passages of ``words`` words or more that repeat: the word windows of the suffix-array dedup.

Words are runs of anything but ASCII white space, so a passage that is wrapped
differently is the same.  Windows of ``words`` words are hashed (64 bits) and
assigned to an *anchor*: the last of the least hashes of the runs of
``gram`` words in the window.  The choice depends on the window's words alone, so equal
windows meet under one gram.  The windows of one anchor are neighbours, its *context*.

1. Grams that occur once are covered nowhere and go first.  Contexts are counted
   by their hash: one that occurs twice is covered whole.
2. Contexts that occur once, in a gram that has several, and one of each context
   of these grams are taken apart into their windows, which are counted by
   gram and hash.  Only counts are exchanged, no group is gathered.

Texts are named by a 64-bit hash.  Texts of fewer than ``words`` words keep all
words; null texts are empty.  Long texts are taken in pieces of ``PIECE`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm import textops as X
from postline.session import written

WORDS = 51                   # over 50 words
GRAM = 24
PIECE = 300_000              # words handled at once; more than a slice of several texts can have
MAX_GRAMS = 1_000_000        # repeated grams that may be broadcast
MAX_IDS = 500_000            # text names that may be broadcast
SEED = 6


def _rolled(words: np.ndarray, k: int, hasher: X.Hasher) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(words)
    if n >= len(hasher.up):
        hasher._grow(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * hasher.up[:n], out=sums[1:])
    return X.mix((sums[k:] - sums[:-k]) * hasher.down[:n - k + 1])


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum over all runs of ``size`` values."""
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = size - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def contexts(data: np.ndarray, offsets: np.ndarray, hasher: X.Hasher, words: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For pieces of concatenated texts: of each context its text, gram hash, hash, first
    window and number of windows; of each window its hash, begin and end (bytes in its text)."""
    starts, ends, first = X.word_spans(data, offsets, X.WORD)
    hashes = hasher.words(data, starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    for lo in range(0, max(1, len(hashes) - words + 1), PIECE):
        piece = slice(lo, lo + PIECE + words - 1)
        w, who, a, b = hashes[piece], owner[piece], starts[piece], ends[piece]
        if len(w) < words:
            continue
        at = np.flatnonzero(who[:len(w) - words + 1] == who[words - 1:])
        if not len(at):
            continue
        grams = _rolled(w, gram, hasher)
        key = grams >> np.uint64(32) << np.uint64(32) | np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64)
        anchor = (np.uint64(0xFFFFFFFF) - (_least(key, words - gram + 1)[at] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        h = _rolled(w, words, hasher)[at]
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(begin, len(at)))
        shape = size.astype(np.uint64) << np.uint64(32) | (anchor[begin] - at[begin]).astype(np.uint64)
        c = X.mix(np.add.reduceat(X.mix(h ^ np.uint64(0x5BD1E995A5A5A5A5)), begin) + X.mix(shape))
        base = offsets[who[at]]
        yield who[at[begin]], grams[anchor[begin]], c, begin, size, h, a[at] - base, b[at + words - 1] - base


def _texts(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.where(F.octet_length(text) >= 2 * words - 1).select(F.xxhash64(text).alias("t"), text.alias("text"))


def anchors(docs: DataFrame, text_col: str, words: int, gram: int) -> DataFrame:
    """All contexts: g (gram hash), c (context hash), t (text name), and the bytes [a, b) that their windows cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = X.Hasher(SEED, fold=False)
        for batch in X.slices(batches, "text"):
            names = np.asarray(batch.column(0))
            for text, g, c, begin, size, _, a, b in contexts(*X.text_bytes(batch.column(1)), hasher, words, gram):
                yield pa.RecordBatch.from_arrays([X.int64(g), X.int64(c), pa.array(names[text]), pa.array(a[begin]), pa.array(b[begin + size - 1])],
                                                 ["g", "c", "t", "a", "b"])
    return _texts(docs, text_col, words).mapInArrow(run, "g long, c long, t long, a long, b long")


def _windows(docs: DataFrame, wanted: DataFrame, text_col: str, words: int, gram: int) -> DataFrame:
    """The windows of wanted contexts (t, a, n): g, h (window hash), n, t and the bytes [a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = X.Hasher(SEED, fold=False)
        for batch in X.slices(batches, "text"):
            names, lists = np.asarray(batch.column(0)), batch.column(2)
            places = lists.flatten()
            want = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths())) << 32 | np.asarray(places.field("a"))
            order = np.argsort(want)
            want, times = want[order], np.asarray(places.field("n"))[order]
            for text, g, _, begin, size, h, a, b in contexts(*X.text_bytes(batch.column(1)), hasher, words, gram):
                key = text << 32 | a[begin]
                place = np.minimum(np.searchsorted(want, key), len(want) - 1)
                mine = want[place] == key
                rows = np.flatnonzero(np.repeat(mine, size))
                of = np.repeat(np.arange(len(text)), size)[rows]
                yield pa.RecordBatch.from_arrays([X.int64(g[of]), X.int64(h[rows]), pa.array(times[place[of]]), pa.array(names[text[of]]),
                                                  pa.array(a[rows]), pa.array(b[rows])], ["g", "h", "n", "t", "a", "b"])

    places = wanted.groupBy("t").agg(F.collect_list(F.struct("a", "n")).alias("places"))
    names = written(wanted.select("t").distinct(), "passage_names")
    texts = _texts(docs, text_col, words)
    texts = texts.join(F.broadcast(names), "t", "left_semi") if names.count() <= MAX_IDS else texts
    texts = texts.groupBy("t").agg(F.first("text").alias("text"))
    return (texts.join(places, "t").select("t", "text", "places")
            .mapInArrow(run, "g long, h long, n long, t long, a long, b long"))


def covered(docs: DataFrame, text_col: str = "text", words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(t, spans): for every text (named by its hash) with a repeated window, the covered intervals (bytes), which may overlap."""
    found = written(anchors(docs, text_col, words, gram), "passage_anchors")
    grams = written(found.groupBy("g").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed"))
                    .where("n > 1").select("g", "mixed"), "passage_grams")
    repeated = found.join(F.broadcast(grams) if grams.count() <= MAX_GRAMS else grams, "g")
    shared = written(repeated.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("t", "a")).alias("one"), F.first("mixed").alias("mixed"))
                     .select("g", "c", "n", "one.t", "one.a", "mixed"), "passage_shared")
    open_ = shared.where("mixed and n = 1").select("g").distinct()
    wanted = written(shared.where("mixed").join(open_, "g", "left_semi").select("t", "a", "n"), "passage_wanted")
    windows = written(_windows(docs, wanted, text_col, words, gram), "passage_windows")
    many = windows.groupBy("g", "h").agg(F.sum("n").alias("times")).where("times > 1").select("g", "h")
    whole = repeated.join(shared.where("n > 1").select("g", "c"), ["g", "c"], "left_semi").select("t", "a", "b")
    part = windows.where("n = 1").join(many, ["g", "h"], "left_semi").select("t", "a", "b")
    return whole.unionByName(part).groupBy("t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
