"""Spelling variant grouping with pivotal grams.

Words that differ by one inserted, deleted or replaced code point are *near*.

1. Words are counted over whole texts; partial sums leave each task, so a frequent word is one row
   of it.
2. Bigrams are ordered by the number of words that hold them, rarest first.  A word's
   *prefix* is its three first bigrams in that order (and all others that tie with the
   third).  One edit can't touch two bigrams that don't overlap, so of a word's
   two *pivots*, disjoint bigrams of its prefix, one survives in any near word; and of two near
   words the one whose prefix ends first in the order has its pivots' survivors in the other's prefix.
   The pivots are chosen by dynamic programming over the prefix's
   positions: of all disjoint pairs, the one held by the fewest words.
3. Pivots meet the prefix bigrams of other words in an equi-join.  Position limits are part of its
   key: the length of the other word (one less, equal, one more) and the place that the pivot can have there.
   So is half of the word: one edit leaves the first or the last half as it was, and the
   bigram meets only words that share the same half.
4. The join keeps the pairs that an edit distance of 1 confirms.  Nothing else leaves it.
5. A word's form is its near word with the largest count, if that is at least
   ``ratio`` times its own; counts grow along forms, so following them ends.  Roots come by
   pointer doubling: each round halves the words still on their way.

Candidates are bounded by the words that share a bigram at a place, a length and
a half word; no bucket holds all words of a bigram.  The bigram table (at
most the square of the alphabet) and numbers per bigram are all that goes through the driver.

Edge cases: null and empty texts have no words; a null id counts as an empty one for the
slip rule; repeated rows are counted again; ties of forms go to the smallest word in code
point order; words are case-folded for A-Z only; words of any length are handled
(memory follows the longest word of a batch); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline.llm import textops as X
from postline.session import written

#: Runs of letters that make words: ASCII letters and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
#: Code point of the first letter of each of the two ranges, after folding.
LATIN, ACCENTED = 0x61, 0xC0
LETTERS = 26 + 64
MIN_CHARS = 5
MIN_COUNT = 3
SLIP = 97                  # runs whose checksum this divides lose a code point
RATIO = 2
PIVOTS = 2                 # one more than edits
PREFIX = 3                 # bigrams of a prefix: any three places hold two that are disjoint


def fold(run: Column) -> Column:
    """Lower-case A-Z only; plain runs take the faster way."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(X.lower_ascii(run))


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, or the run without one code point if its checksum says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words with their number of places."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_chars).select("doc_id", fold(F.col("run")).alias("run"))
    words = runs.select(slipped(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and letters (a matrix of letter numbers) of the words of each length."""
    words = column.to_pylist()
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letters = np.where(flat < 0x80, flat - LATIN, flat - ACCENTED + 26)
    start = np.cumsum(size) - size
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield rows, letters[start[rows][:, None] + np.arange(length)]


def bigrams(letters: np.ndarray) -> np.ndarray:
    return letters[:, :-1] * LETTERS + letters[:, 1:]


def gram_ranks(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each bigram its number of places in words, and its place in the order, rarest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS * LETTERS, np.int64)
        for batch in batches:
            for _, letters in by_length(batch.column(0)):
                total += np.bincount(bigrams(letters).ravel(), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["g", "c"])

    found = words.select("word").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).collect()
    count = np.zeros(LETTERS * LETTERS, np.int64)
    for g, c in found:
        count[g] = c
    rank = np.empty(len(count), np.int64)
    rank[np.lexsort([np.arange(len(count)), count])] = np.arange(len(count))
    return count, rank


def prefix(grams: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bigrams of each word belong to its prefix, and the rank of the prefix's last."""
    order = rank[grams]
    last = np.partition(order, PREFIX - 1, axis=1)[:, PREFIX - 1]
    return order <= last[:, None], last


def pivots(grams: np.ndarray, inside: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of ``PIVOTS`` disjoint bigrams of the prefix with the least total
    count.  best[j, i]: least total of j bigrams within the first i places, the last of
    them chosen at place ``took[j, i]``."""
    rows, places = grams.shape
    cost = np.where(inside, count[grams].astype(np.float64), np.inf)
    best = np.full((PIVOTS + 1, places + 1, rows), np.inf)
    took = np.zeros((PIVOTS + 1, places + 1, rows), np.int64)
    best[0] = 0
    for j in range(1, PIVOTS + 1):
        for i in range(1, places + 1):
            here = cost[:, i - 1] + best[j - 1, max(i - 2, 0)]
            better = here < best[j, i - 1]
            best[j, i] = np.where(better, here, best[j, i - 1])
            took[j, i] = np.where(better, i - 1, took[j, i - 1])
    out, end = np.empty((rows, PIVOTS), np.int64), np.full(rows, places)
    for j in range(PIVOTS, 0, -1):
        out[:, j - 1] = took[j, end, np.arange(rows)]
        end = np.maximum(out[:, j - 1] - 1, 0)
    return out


def _half(letters: np.ndarray, shared: int, first: bool) -> np.ndarray:
    """A number for the first or last half of what words have in common with near words when ``shared``
    letters, the shorter one's length, are compared."""
    head = shared // 2
    part = letters[:, :head] if first else letters[:, letters.shape[1] - (shared - head):]
    out = np.full(len(part), 2 * shared + first, np.uint64)
    for column in part.T:
        out = X.mix(out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return out


def _key(half: np.ndarray, gram: np.ndarray, place, length: int) -> np.ndarray:
    return X.mix(half ^ X.mix((gram.astype(np.uint64) << np.uint64(40)) + (np.asarray(place).astype(np.uint64) << np.uint64(20)) + np.uint64(length)))


def index_keys(letters: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the prefix bigrams of words of one length: row, key, rank of the prefix's last."""
    length, grams = letters.shape[1], bigrams(letters)
    inside, last = prefix(grams, rank)
    row, place = np.nonzero(inside)
    keys = [_key(_half(letters, shared, first)[row], grams[row, place], place, length) for shared in (length, length - 1) for first in (True, False)]
    return np.tile(row, len(keys)), np.concatenate(keys), np.tile(last[row], len(keys))


def probe_keys(letters: np.ndarray, rank: np.ndarray, count: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that the pivots of words of one length look for: row, key, rank of the prefix's last."""
    length, grams = letters.shape[1], bigrams(letters)
    inside, last = prefix(grams, rank)
    place = pivots(grams, inside, count)
    rows, keys = [], []
    for other in (length - 1, length, length + 1):
        if other < min_chars:
            continue
        shared = min(length, other)
        head = shared // 2
        tail = length - (shared - head)                 # where the last half begins here
        for first in (True, False):
            half = _half(letters, shared, first)
            for p in place.T:
                fixed = p + 2 <= head if first else p >= tail        # the bigram lies in the half that stays
                moved = other - length
                for shift in {0, moved}:
                    may = ~fixed | (shift == (0 if first else moved))
                    may &= (p + shift >= 0) & (p + shift <= other - 2)
                    at = np.flatnonzero(may)
                    rows.append(at)
                    keys.append(_key(half[at], grams[at, p[at]], p[at] + shift, other))
    row = np.concatenate(rows)
    return row, np.concatenate(keys), last[row]


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b): all ordered pairs of near words."""
    count, rank = gram_ranks(words)

    def keyed(keys, name):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    column = batch.column(0).slice(i, 4096)
                    for rows, letters in by_length(column):
                        row, key, last = keys(letters)
                        yield pa.RecordBatch.from_arrays([X.int64(key), column.take(pa.array(rows[row])), pa.array(last.astype(np.int32))], ["key", name, f"{name}_last"])
        return words.select("word").mapInArrow(run, f"key long, {name} string, {name}_last int")

    probes = keyed(lambda letters: probe_keys(letters, rank, count, min_chars), "a")
    index = keyed(lambda letters: index_keys(letters, rank), "b")
    near = (F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    found = written(probes.join(index.hint("merge"), "key").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "variant_pairs")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: where following the forms (word, form) ends.
    Each round, words whose pointer is still ``open`` (leads to a word with a form) take over
    the pointer of the word they point at; the others are only looked up."""
    links = forms.where("form is not null")
    steps = written(links.select("word", F.col("form").alias("at"))
                    .join(links.select(F.col("word").alias("at"), F.lit(True).alias("more")), "at", "left")
                    .select("word", "at", F.coalesce("more", F.lit(False)).alias("open")), "variant_steps")
    while not steps.where("open").isEmpty():
        ahead = steps.select(F.col("word").alias("at"), F.col("at").alias("next"), F.col("open").alias("more"))
        moved = steps.where("open").join(ahead, "at").select("word", F.col("next").alias("at"), F.col("more").alias("open"))
        steps = written(steps.where("not open").unionByName(moved), "variant_steps")
    return steps.select("word", F.col("at").alias("root"))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    if min_chars <= PREFIX:
        raise ValueError(f"words need {PREFIX} bigrams")
    words = written(count_words(docs, id_col, text_col, min_chars, min_count), "variant_words")
    pairs = near_pairs(words, min_chars).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    near = pairs.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("one"))
    found = words.join(near.select(F.col("a").alias("word"), "n_near", F.col("one.b").alias("b"), (-F.col("one.less")).alias("b_n")), "word", "left")
    is_form = F.col("b_n") >= ratio * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(is_form, F.col("b")).alias("form"), F.when(is_form, F.col("b_n")).alias("form_n")), "variant_forms")
    return (found.join(roots(found), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
