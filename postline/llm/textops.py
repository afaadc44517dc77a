"""Shared helpers: table access, Arrow text buffers, vectorised word and
shingle hashing.

Text is handled as UTF-8 bytes.  Null texts are empty everywhere.  All
helpers that run in tasks work on slices of bounded size, so their memory
follows the slice (or one single text, if that is longer), not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19          # bytes of text handled at once inside a task
HASH_BYTES = 1 << 18           # bytes hashed at once (stays in cache)
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SHINGLE = 5                    # words of a shingle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(col):
    """Lower-case A-Z only; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``limit`` bytes of
    text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = filled(batch.column(batch.schema.get_field_index(text)))
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def filled(col: pa.Array) -> pa.Array:
    return col.fill_null("") if col.null_count else col


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offsets of the texts."""
    col = filled(col)
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_class(members: bytes, invert: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return ~out if invert else out


#: Bytes of a word: everything but ASCII white space.
WORD = byte_class(SPACE, invert=True)
#: Bytes of a plain word: ASCII letters and digits, and every byte of other characters.
PLAIN = byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), invert=True)
#: Lower-cases A-Z.
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of member bytes that don't cross
    texts), and for each text the number of words before it."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """64-bit hashes of words and shingles, by prefix sums of a polynomial
    modulo 2**64 over a random byte table; the same seed gives the same
    hashes in every task."""

    def __init__(self, seed: int = 1, fold: bool = True):
        rng = np.random.RandomState(seed)
        table = rng.randint(1, 2 ** 63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.table = table[LOWER] if fold else table
        self.base = (rng.randint(1, 2 ** 62, dtype=np.int64) << 1) | 1
        self.steps = rng.randint(1, 2 ** 63 - 1, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self._grow(HASH_BYTES + 4096)

    def _grow(self, n: int) -> None:
        inverse = pow(int(self.base), -1, 1 << 64)
        one = np.ones(1, np.uint64)
        self.up = np.concatenate([one, np.multiply.accumulate(np.full(n, int(self.base), np.uint64))])
        self.down = np.concatenate([one, np.multiply.accumulate(np.full(n, inverse, np.uint64))])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, side="right")))
            at, to = starts[i], ends[j - 1]
            if to - at >= len(self.up):
                self._grow(int(to - at))
            sums = np.zeros(to - at + 1, np.uint64)
            np.cumsum(self.table[data[at:to]] * self.up[:to - at], out=sums[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((sums[e] - sums[s]) * self.down[s])
            i = j
        return out

    def shingles(self, words: np.ndarray, first: np.ndarray, k: int = SHINGLE,
                 short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside each text, and the text of
        each.  A text of 1 to k-1 words is one shingle of all its words
        (``short``); a text without words has none."""
        n = len(words)
        count = np.diff(first)
        owner = np.repeat(np.arange(len(count)), count)
        if n >= k:
            h = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                h += words[j:n - k + 1 + j] * self.steps[j]
            keep = owner[:n - k + 1] == owner[k - 1:]
            h, who = mix(h[keep]), owner[:n - k + 1][keep]
        else:
            h, who = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = np.flatnonzero((count > 0) & (count < k)) if short else ()
        if len(few):
            more = np.array([int(np.sum(words[first[d]:first[d + 1]] * self.steps[:count[d]])) & (2 ** 64 - 1)
                             for d in few], np.uint64) + count[few].astype(np.uint64) * self.steps[k]
            h, who = np.concatenate([h, mix(more)]), np.concatenate([who, few])
            order = np.argsort(who, kind="stable")
            h, who = h[order], who[order]
        return h, who


def binary_rows(parts: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per row: parts[bounds[i]:bounds[i+1]] as bytes."""
    size = parts.dtype.itemsize
    raw = np.ascontiguousarray(parts)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1,
                                       [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(raw)])


def int64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str | list[str], max_rows: int = 500_000) -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (the columns of
    ``id_col``, null-safe).  The ids are written once; they are broadcast only if their
    number, measured then, is within ``max_rows``; else they are the build side of a hash join."""
    from postline.session import written
    cols = [id_col] if isinstance(id_col, str) else id_col
    ids = written(ids.toDF(*[f"_drop{i}" for i in range(len(cols))]).distinct(), "drop_ids")
    same = [docs[c].eqNullSafe(ids[f"_drop{i}"]) for i, c in enumerate(cols)]
    ids = F.broadcast(ids) if ids.count() <= max_rows else ids.hint("shuffle_hash")
    return docs.join(ids, same, "left_anti")


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def text_name(col):
    """The 64-bit hash that names a text (null: empty)."""
    return F.xxhash64(F.coalesce(col, F.lit("")))


def let(value, body):
    """``body(v)`` with ``v`` evaluated once a row, also where ``body`` uses it
    several times or inside lambdas: a one-element fold that keeps its start."""
    return F.aggregate(F.array(F.lit(0)), value, lambda kept, _: kept, body)
