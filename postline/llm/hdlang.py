"""Language identification by hyperdimensional profiles.

Every letter (and the blank between words) has a random vector of +1 and -1,
drawn from its code point.  A trigram abc is bound into one vector: the
letters' vectors, permuted by their place (rotated twice, once, not at all)
and multiplied.  A text's vector is the bundle (sum) of the vectors of all its
trigrams, over lower-cased letters with one blank for each run of other
characters.  A language's prototype is the bundle of its training texts, each scaled
to length one, so that long texts weigh like short ones; the mean of the
prototypes is subtracted, which removes what the languages share.  A text gets the
language whose prototype has the highest cosine with it.

Training sends one vector per task and language through the shuffle; the model is
one vector per language (``MAX_LANGS`` is checked before it is
sent to the tasks), whatever the size of the corpus.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is every text
when there is no training text; ties go to the smaller language name; null
languages are not learned; repeated rows count as often as they occur in
training and are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline.llm import textops as X

DIMENSIONS = 1024
MAX_LANGS = 10_000
SEED = 7
BLANK = 32
LETTERS = 1 << 16            # letters beyond it share the vectors of smaller ones


def letter_table() -> np.ndarray:
    """For each code point: the lower-case letter (below LETTERS), or a blank."""
    table = np.full(sys.maxunicode + 1, BLANK, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return np.where(table >= LETTERS, table % LETTERS | 1 << 15, table).astype(np.uint32)


PIECE = 1 << 20              # characters and trigrams handled at once


def letters_of(text: str, table: np.ndarray) -> np.ndarray:
    """Lower-case letters of a text between two blanks, one blank for each run of other characters."""
    blank = np.full(1, BLANK, np.uint16)
    parts = [table[np.frombuffer(text[i:i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint16) for i in range(0, len(text), PIECE)]
    letters = np.concatenate([blank, *parts, blank])
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != BLANK) | (letters[:-1] != BLANK)
    return letters[keep]


def trigrams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, trigram) pairs and how often they occur; a trigram is 48 bits (three letters)."""
    found = [letters_of(t, table) for t in texts]
    letters = np.concatenate([*found, np.zeros(0, np.uint16)])
    ends = np.cumsum([len(f) for f in found])
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at in range(0, max(len(letters) - 2, 0), PIECE):
        to = min(at + PIECE, len(letters) - 2)
        x, start = letters[at:to + 2].astype(np.uint64), np.arange(at, to)
        owner = np.searchsorted(ends, start, side="right")
        grams = owner.astype(np.uint64) << np.uint64(48) | x[:-2] << np.uint64(32) | x[1:-1] << np.uint64(16) | x[2:]
        k, c = np.unique(grams[start + 2 < ends[owner]], return_counts=True)
        keys.append(k)
        counts.append(c)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


class Space:
    """Letter vectors and the trigram vectors bound from them, kept as they are met."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.n, self.letters = dimensions, {}
        self.places: dict[int, int] = {}
        self.bound = np.zeros((4096, dimensions), np.float32)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = np.random.RandomState(SEED * LETTERS + c).choice(np.array([-1, 1], np.float32), self.n)
        return self.letters[c]

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of distinct trigrams."""
        if len(self.places) + len(grams) > 1 << 16:
            self.places = {}
        out = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            at = self.places.get(g)
            if at is None:
                at = self.places[g] = len(self.places)
                if at >= len(self.bound):
                    self.bound = np.concatenate([self.bound, np.zeros_like(self.bound)])
                self.bound[at] = (np.roll(self.letter(g >> 32), 2) * np.roll(self.letter(g >> 16 & 65535), 1) * self.letter(g & 65535))
            out[i] = at
        return self.bound[out]

    def bundle(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        """The vectors of texts (zero for a text without letters).  Long texts
        are bundled in pieces, whole."""
        out = np.zeros((len(texts), self.n), np.float32)
        who, grams, counts = trigrams(texts, table)
        distinct, place = np.unique(grams, return_inverse=True)
        blank = np.uint64(BLANK << 32 | BLANK << 16 | BLANK)
        counts = np.where(grams == blank, 0, counts)
        for at in range(0, len(distinct), 4096):
            part = (place >= at) & (place < at + 4096)
            weights = np.zeros((len(texts), min(4096, len(distinct) - at)), np.float32)
            weights[who[part], place[part] - at] = counts[part]
            out += weights @ self.rows(distinct[at:at + 4096])
        return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in X.slices(batches, "text", 1 << 18):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]


def has_letter(texts: list[str], table: np.ndarray) -> np.ndarray:
    def any_letter(t: str) -> bool:
        return any(c.isalpha() for c in t[:64]) or bool((letters_of(t, table) != BLANK).any())

    return np.array([any_letter(t) for t in texts], bool)


def profiles(training: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per language: lang, n (training texts with a letter), profile (array of double, the bundle)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, space, sums, n = letter_table(), Space(dimensions), {}, {}
        for batch, texts in _texts(batches):
            vectors = space.bundle(texts, table)
            length = np.sqrt((vectors * vectors).sum(1))
            known = has_letter(texts, table) & (length > 0)
            vectors[known] /= length[known, None]
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs[known]):
                mine = known & (langs == lang)
                sums[lang] = sums.get(lang, 0) + vectors[mine].sum(0, dtype=np.float64)
                n[lang] = n.get(lang, 0) + int(mine.sum())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([n[x] for x in sums], pa.int64()),
                                              pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "n", "v"])

    parts = (training.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
             .mapInArrow(run, "lang string, n long, v array<double>"))
    counts = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    sums = (parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("profile")))
    return counts.join(sums, "lang")


def predict(docs: DataFrame, model: list[tuple[str, list[float]]], id_col: str = "doc_id", text_col: str = "text",
            dimensions: int = DIMENSIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep``, lang_pred and score (the cosine, clipped to 0..1)."""
    names = sorted(m[0] for m in model)
    if names:
        prototypes = np.array([v for _, v in sorted(model, key=lambda m: m[0])])
        prototypes /= np.maximum(np.sqrt((prototypes ** 2).sum(1, keepdims=True)), 1e-12)
        if len(names) > 1:
            prototypes = prototypes - prototypes.mean(0)
        prototypes /= np.maximum(np.sqrt((prototypes ** 2).sum(1, keepdims=True)), 1e-12)
        prototypes = prototypes.astype(np.float32)
    else:
        prototypes = np.zeros((0, dimensions), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, space = letter_table(), Space(dimensions)
        names, prototypes = shared.value
        for batch, texts in _texts(batches):
            vectors = space.bundle(texts, table)
            cosine = vectors @ prototypes.T / np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-12)
            known = has_letter(texts, table) & bool(names)
            best = cosine.argmax(1) if names else np.zeros(len(texts), int)
            score = np.where(known, np.clip(cosine.max(1, initial=0.0), 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([names[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                                              pa.array(score.astype(np.float64))], [*batch.schema.names[:-1], "lang_pred", "score"])

    docs = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{shape}, lang_pred string, score double")


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             keep: tuple[str, ...] = (), dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn from the rows where ``training`` holds, predict all rows."""
    learned = profiles(docs.where(training), lang_col, text_col, dimensions)
    model = [(r["lang"], r["profile"]) for r in learned.limit(MAX_LANGS + 1).collect()]
    if len(model) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return predict(docs, model, id_col, text_col, dimensions, keep)
