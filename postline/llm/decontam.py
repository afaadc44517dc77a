"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is *contained* in a document when at least ``threshold`` of the
item's distinct five-word shingles occur somewhere in the document.  A word is
a run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  An
item of one to four words is one shingle of all its words; an item without
words is never contained.

Jaccard similarity says nothing about a short item inside a long document, so
the sketch is taken of the short side.  Items are partitioned by size (powers
of two of their shingle count).  An item's sketch holds the r shingles with
the smallest hashes, r fixed for the partition: one more than the shingles
that the partition's largest item may miss.  A contained item misses at most
``n - need`` shingles, so at least ``r - (n - need) >= 1`` sketch shingles occur
in the document: the sketch loses no item, and candidates with fewer hits are
dropped.  Candidates are verified on the shingles themselves, not on hashes.

Documents are read once and never shuffled while the sketches fit the stated
bound (``MAX_INDEX`` shingles, ``MAX_TEXT`` characters of items, measured before
they are broadcast); beyond it documents and sketches meet in a join by
shingle, with the same result.

Edge cases: null texts are empty; a null id is an id like any other; repeated
ids of documents or items give one row per pair of ids (the highest
containment); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postline.llm import textops as X

THRESHOLD = 0.8
MAX_INDEX = 2_000_000        # sketch shingles that may be broadcast
MAX_TEXT = 50_000_000        # characters of items that may be broadcast
SEED = 5

#: Maps bytes to lower-case word bytes, all others to a blank.
PLAIN_TABLE = bytes(int(X.LOWER[c]) if X.PLAIN[c] or 0x41 <= c <= 0x5A else 0x20 for c in range(256))
MEMBER = X.byte_class(bytes(c for c in range(256) if PLAIN_TABLE[c] == 0x20), invert=True)


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN_TABLE).split(b" ") if text else []


def shingle_set(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


def item_shingles(text: str | None, k: int) -> tuple[int, set[bytes]]:
    words = [w for w in plain_words(text) if w]
    width = min(k, len(words))
    return width, shingle_set(words, width) if width else set()


def _need(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def sketch_length(n: int, threshold: float) -> int:
    """Shingles in the sketch of an item of n: one more than the largest item
    of its partition may miss (all of them if it has no more)."""
    top = 2 ** n.bit_length() - 1
    return min(n, top - _need(top, threshold) + 1)


def _sketch(text: str | None, k: int, threshold: float, hasher: X.Hasher) -> tuple[int, int, int, np.ndarray]:
    """Shingle width, shingles, hits that a contained item has at least, sketch."""
    width, found = item_shingles(text, k)
    if not found:
        return 0, 0, 0, np.zeros(0, np.uint64)
    joined = np.frombuffer(b"".join(found), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(s) for s in found])])
    starts, ends, at = X.word_spans(joined, first, MEMBER)
    hashes, _ = hasher.shingles(hasher.words(joined, starts, ends), at, width, short=False)
    n = len(found)
    r = sketch_length(n, threshold)
    return width, n, r - (n - _need(n, threshold)), np.sort(hashes)[:r]


def sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD,
             k: int = X.SHINGLE) -> DataFrame:
    """One row per sketch shingle: item (its id), width, size (shingles of
    the item), hits (sketch hits of a contained item at least), hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = X.Hasher(SEED, fold=False)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                width, n, hits, hashes = _sketch(text, k, threshold, hasher)
                m = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * m, key.type), pa.array([width] * m, pa.int32()),
                                                  pa.array([n] * m, pa.int32()), pa.array([hits] * m, pa.int32()),
                                                  X.int64(hashes)], ["item", "width", "size", "hits", "hash"])
    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("item"), F.col(text_col).alias("t")).mapInArrow(
        run, f"item {kind}, width int, size int, hits int, hash long")


def _shingle_hashes(batch: pa.RecordBatch, widths: list[int], hasher: X.Hasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw, offsets = X.text_bytes(batch.column(1))
    data = np.frombuffer(PLAIN_TABLE, np.uint8)[raw]
    starts, ends, first = X.word_spans(data, offsets, MEMBER)
    words = hasher.words(data, starts, ends)
    for width in widths:
        yield hasher.shingles(words, first, width, short=False)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
           item_text: str = "text", threshold: float = THRESHOLD, k: int = X.SHINGLE, max_index: int = MAX_INDEX,
           max_text: int = MAX_TEXT) -> DataFrame:
    """Contained items: ``doc_id, item_id, n_shingles`` (distinct shingles of
    the item), ``n_found`` (of these in the document), ``containment``."""
    doc_type, item_type = (df.schema[c].dataType for df, c in ((docs, doc_id), (items, item_id)))
    out = T.StructType([T.StructField("doc_id", doc_type), T.StructField("item_id", item_type),
                        T.StructField("n_shingles", T.LongType()), T.StructField("n_found", T.LongType())])
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    index = sketches(items, threshold=threshold, k=k)
    size = index.agg(F.count("*"), F.collect_set("width")).first()
    text = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size[0] <= max_index and text <= max_text:
        found = docs.mapInArrow(_probe(docs.sparkSession, items, threshold, k), out)
    else:
        found = _joined(docs, items, index, sorted(size[1]), k, out)
    return (found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_shingles", "n_found")).alias("m"))
            .select("doc_id", "item_id", "m.n_shingles", "m.n_found",
                    (F.col("m.n_found") / F.col("m.n_shingles")).alias("containment"))
            .where(F.col("containment") >= threshold - 1e-9))


def _probe(spark, items: DataFrame, threshold: float, k: int):
    """The task function for sketches within the bound."""
    shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = X.Hasher(SEED, fold=False)
        rows = shared.value
        kinds, hashes, owner, hits = [], [], [], np.zeros(len(rows), np.int64)
        for i, (_, text) in enumerate(rows):
            width, _, hits[i], sketch = _sketch(text, k, threshold, hasher)
            kinds += [width] * len(sketch)
            hashes.append(sketch)
            owner += [i] * len(sketch)
        kinds, owner = np.array(kinds, np.int64), np.array(owner, np.int64)
        hashes = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.lexsort((hashes, kinds))
        kinds, owner, hashes = kinds[order], owner[order], hashes[order]
        widths, known, index = [int(w) for w in np.unique(kinds)], {}, {}
        bits = np.uint64(64 - max(16, int(len(hashes) * 32).bit_length()))
        for w in widths:
            keys, at = np.unique(hashes[kinds == w], return_index=True)
            mask = np.zeros(1 << (64 - int(bits)), bool)
            mask[keys >> bits] = True
            index[w] = mask, keys, np.append(at, (kinds == w).sum()), owner[kinds == w]
        for batch in X.slices(batches, "text"):
            pairs = []
            for w, (h, who) in zip(widths, _shingle_hashes(batch, widths, hasher)):
                mask, keys, at, posted = index[w]
                maybe = np.flatnonzero(mask[h >> bits])
                place = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                sure = keys[place] == h[maybe]
                if sure.any():
                    hit = np.unique(who[maybe[sure]] * len(keys) + place[sure])
                    d, key = np.divmod(hit, len(keys))
                    times = at[key + 1] - at[key]
                    items_hit = posted[np.repeat(at[key], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                    both, n = np.unique(np.repeat(d, times) * len(rows) + items_hit, return_counts=True)
                    pairs += [divmod(int(p), len(rows)) for p in both[n >= hits[both % len(rows)]]]
            ids, out, sets, last = batch.column(0), [], {}, -1
            for d, i in sorted(pairs):
                if d != last:
                    last, sets = d, {}
                    words = [w for w in plain_words(batch.column(1)[d].as_py()) if w]
                if i not in known:
                    known[i] = item_shingles(rows[i][1], k)
                width, wanted = known[i]
                if width not in sets:
                    sets[width] = shingle_set(words, width)
                n = len(wanted & sets[width])
                if n >= _need(len(wanted), threshold):
                    out.append((ids[d].as_py(), rows[i][0], len(wanted), n))
            if out:
                d, i, a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(d, ids.type), pa.array(i), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                 ["doc_id", "item_id", "n_shingles", "n_found"])
    return run


def _joined(docs: DataFrame, items: DataFrame, index: DataFrame, widths: list[int], k: int, out: T.StructType) -> DataFrame:
    """Sketches beyond the broadcast bound: documents' shingles meet the
    sketches in a join by shingle; candidate pairs are verified in rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = X.Hasher(SEED, fold=False)
        for batch in X.slices(batches, "text"):
            for w, (h, who) in zip(widths, _shingle_hashes(batch, widths, hasher)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(np.full(len(h), w, np.int32)), X.int64(h)],
                                                 ["doc_id", "width", "hash"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for text, item in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                width, wanted = item_shingles(item, k)
                a.append(len(wanted))
                b.append(len(wanted & shingle_set([w for w in plain_words(text) if w], width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                             ["doc_id", "item_id", "n_shingles", "n_found"])

    shingles = docs.mapInArrow(explode, f"doc_id {kind}, width int, hash long").distinct()
    pairs = (shingles.join(index, ["width", "hash"]).groupBy("doc_id", "item").agg(F.count("*").alias("n"), F.max("hits").alias("hits"))
             .where("n >= hits").select(F.col("doc_id").alias("d"), F.col("item").alias("i")))
    full = (pairs.join(docs, F.col("d").eqNullSafe(F.col("doc_id"))).select("d", "i", F.col("text").alias("t"))
            .join(items, F.col("i").eqNullSafe(F.col("item_id"))).select("d", "i", "t", F.coalesce("text", F.lit("")).alias("u")))
    return full.mapInArrow(verify, out)


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", **options) -> DataFrame:
    """The documents (all their columns) that contain no item.  Texts are
    searched under their own name, so ids may be null or repeat."""
    name = X.fresh(docs, "_text_name")
    named = docs.withColumn(name, X.text_name(F.col(doc_text)))
    return X.drop_ids(named, search(named, items, name, doc_text, **options).select("doc_id"), name).drop(name)
