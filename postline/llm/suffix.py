"""Suffix-array dedup: removes every byte that a repeated string of ``length``
bytes covers.

Exact, yet without sorting a suffix for every byte.  Suffixes are sampled at
*anchors*: a position is one if the hash of its ``gram`` leading bytes is the least
in some window of ``length`` bytes.  The choice depends on the window's bytes
alone, so two equal windows have an anchor at the same place, and every
window belongs to an anchor whose leading gram it contains.  An anchor's *context* is
all that its windows see, from some bytes before it to at most ``length`` bytes after
it.  Windows of one anchor that repeat cover one run of bytes around it, so each context
needs two numbers: how far it is covered to the left and to the right.

1. Grams that occur once are covered nowhere and go first (partial aggregates of
   hashes).  The other contexts are counted by their hash: one that occurs twice
   is covered whole.  A context that occurs once, in a gram that has several, is open.
2. Open contexts and one of each context they may share with are fetched.  Splitters,
   sampled from the suffixes' leading bytes, range-partition them; equal grams stay in
   one bucket (suffixes that start with several splitters are spread by their gram), so
   nothing has to be compared across a boundary that could match.  Buckets are sorted
   by multikey quicksort; the common lengths of neighbours, and those of
   the sorted left sides, give the classes of equal windows for each offset.
3. Grams with more than ``GROUP`` contexts are never gathered.  Their windows are
   split into bands of offsets: contexts that share all a band can see are
   covered in it, those that share nothing of what all its windows see are not, and
   only the rest is split into narrower bands, down to single windows.
   Every step is a count by hash.
4. Covered runs return to the texts by a join, and the bytes are cut.

Matches never cross texts.  Texts are named by a 64-bit hash, so equal texts (a
hot group of copies) are one from the start of step 4.  Long texts are read in
pieces with enough of their surroundings.

Edge cases: null texts are empty; texts shorter than ``length`` keep all bytes;
rows with equal text are copies of one another, so all their bytes go if there
are ``length`` of them; null and repeated ids are kept as they are; empty tables
give no rows; other columns are ignored or, in ``dedup``, carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm import passages
from postline.llm import textops as X
from postline.session import written

LENGTH = 400
GRAM = 192
GROUP = 20_000               # contexts of one gram compared in one task at most
BANDS = (105, 15, 3, 1)
BUCKET_ROWS = 20_000         # suffixes sorted in one task
MAX_RANGES = 4_096           # ranges of leading bytes; more buckets than that share ranges
MAX_GRAMS = 1_000_000        # repeated grams that may be broadcast
PIECE = 1 << 22              # bytes of one text read at once
MAX_IDS = 500_000            # text names that may be broadcast
SEED = 6


class Finder:
    """Anchors of concatenated texts; one per task."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.windows = length, gram, length - gram + 1
        self.hasher = X.Hasher(SEED, fold=False)

    def _slide(self, x: np.ndarray, pick) -> np.ndarray:
        """pick (minimum or maximum) over all runs of ``windows`` values."""
        have = 1
        while 2 * have <= self.windows:
            x = pick(x[:-have], x[have:])
            have *= 2
        rest = self.windows - have
        return pick(x[:-rest], x[rest:]) if rest else x

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Positions of the anchors, their text, gram hash, context hash, and
        the context's bytes to the left and right."""
        n, length, gram = len(data), self.length, self.gram
        if n < length:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        if n >= len(self.hasher.up):
            self.hasher._grow(n)
        up, down = self.hasher.up, self.hasher.down
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hasher.table[data] * up[:n], out=sums[1:])
        grams = X.mix((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
        rank = np.maximum((grams >> np.uint64(32)).astype(np.uint32), 1)
        least = self._slide(rank, np.minimum)
        inside = np.zeros(n + 2, np.int8)
        long = np.diff(offsets) >= length
        inside[offsets[:-1][long]] += 1
        inside[offsets[1:][long] - length + 1] -= 1
        least = least * (np.cumsum(inside[:len(least)]) > 0)
        # runs of windows with one least value; an anchor holds that value in all of them that contain it
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], len(least)) - 1
        first, last = first[least[first] > 0], last[least[first] > 0]
        value = least[first].astype(np.uint64) << np.uint64(32)
        around = np.zeros(len(least) + 2 * (self.windows - 1), np.uint32)
        around[self.windows - 1:self.windows - 1 + len(least)] = least
        at = np.flatnonzero(self._slide(around, np.maximum) == rank)
        key = np.sort(rank[at].astype(np.uint64) << np.uint64(32) | at.astype(np.uint64))
        lo = np.searchsorted(key, value | first.astype(np.uint64))
        hi = np.searchsorted(key, value | (last + self.windows - 1).astype(np.uint64), side="right")
        run = np.repeat(np.arange(len(first)), hi - lo)
        at = (key[np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.maximum(first[run], at - self.windows + 1)
        end = np.minimum(last[run], at) + length
        text = np.searchsorted(offsets, at, side="right") - 1
        context = X.mix(X.mix((sums[end] - sums[begin]) * down[begin]) + ((at - begin) * 1024 + end - at).astype(np.uint64))
        return at, text, grams[at], context, at - begin, end - at


def _text(docs: DataFrame, text_col: str):
    return F.coalesce(docs[text_col], F.lit(""))


def anchors(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (g, c, t, at, lead): gram hash, context hash, text name, position with
    the context's extent (packed: position, 10 bits left, 10 bits right), and the
    suffix's first bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(length, gram)
        for batch in X.slices(batches, "text"):
            data, offsets = X.text_bytes(batch.column(1))
            names = np.asarray(batch.column(0))
            if len(data) <= PIECE or batch.num_rows > 1:
                parts = [(0, len(data), 0, len(data), offsets)]
            else:   # one long text, in pieces with their surroundings
                parts = [(max(0, a - 2 * length), min(len(data), a + PIECE + 2 * length), a, a + PIECE, None) for a in range(0, len(data), PIECE)]
            for lo, hi, own, to, bounds in parts:
                at, text, g, c, left, right = finder.find(data[lo:hi], np.array([0, hi - lo]) if bounds is None else bounds)
                mine = (at + lo >= own) & (at + lo < to)
                at, text, g, c, left, right = (x[mine] for x in (at, text, g, c, left, right))
                place = at + lo - offsets[text]
                lead = np.zeros(len(at), np.int64)
                for k in range(min(7, gram)):
                    lead = lead << 8 | data[at + lo + k]
                yield pa.RecordBatch.from_arrays([X.int64(g), X.int64(c), pa.array(names[text]), pa.array(place << 20 | left << 10 | right), pa.array(lead)],
                                                 ["g", "c", "t", "at", "lead"])

    text = _text(docs, text_col)
    return (docs.where(F.octet_length(text) >= length).select(F.xxhash64(text).alias("t"), text.alias("text"))
            .mapInArrow(run, "g long, c long, t long, at long, lead long"))


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words: three-way partitions word by word."""
    order = np.arange(len(words))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        rows = order[a:b]
        if b - a <= 64:
            order[a:b] = rows[np.lexsort(words[rows, depth:].T[::-1])]
            continue
        key = words[rows, depth]
        pivot = np.sort(key[[0, (b - a) // 2, b - a - 1]])[1]
        less, same = key < pivot, key == pivot
        order[a:b] = np.concatenate([rows[less], rows[same], rows[~(less | same)]])
        i, j = a + int(less.sum()), a + int(less.sum() + same.sum())
        todo += [(a, i, depth), (i, j, depth + 1), (j, b, depth)]
    return order


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(v.ljust(width, b"\x00") for v in values), np.uint8).reshape(len(values), width), size


def _common(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common start of each row and the one before it (0 for the first)."""
    out = np.zeros(len(m), np.int64)
    for a in range(1, len(m), 8192):
        b = min(a + 8192, len(m))
        differ = m[a:b] != m[a - 1:b - 1]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


def compare(suffix: list[bytes], left: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the suffixes of some contexts; returns their order and, in that order,
    how far each context is covered to the left and right (0, 0: not at all)."""
    width = lambda n: -(-n // 8) * 8
    s, s_size = _matrix(suffix, width(length))
    order = multikey_quicksort(s.view(">u8").astype(np.uint64))
    s, s_size, left = s[order], s_size[order], [left[i] for i in order]
    n = len(order)
    near = _common(s, s_size)                       # with the row before
    group = np.cumsum(near < gram)
    p, p_size = _matrix(left, max(8, width(length - gram)))
    by_left = np.concatenate([group.astype(">u8").view(np.uint8).reshape(n, 8), p], 1)
    back = multikey_quicksort(by_left.view(">u8").astype(np.uint64))
    near_left = _common(by_left[back], p_size[back] + 8) - 8    # below 0: another group
    to_left, to_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    many = np.bincount(group, minlength=int(group[-1]) + 1)[group] > 1
    for offset in range(0, length - gram + 1):
        can = many & (p_size >= offset) & (s_size >= length - offset)
        if not can.any():
            continue
        right_class = np.cumsum(near < length - offset)
        left_class = np.empty(n, np.int64)
        left_class[back] = np.cumsum(near_left < offset)
        at = np.flatnonzero(can)
        key = right_class[at] * (n + 1) + left_class[at]
        ranked = np.argsort(key)
        same = key[ranked][1:] == key[ranked][:-1]
        twice = at[ranked[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        to_left[twice] = offset
        to_right[twice] = np.maximum(to_right[twice], length - offset)
    return order, to_left, to_right


def _buckets(length: int, gram: int):
    """Task function of step 2: all rows of a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        rows = pa.Table.from_batches(found)
        order, l, r = compare(rows.column("suffix").to_pylist(), rows.column("left").to_pylist(), length, gram)
        hit = l + r > 0
        at = pa.array(order[hit])
        yield pa.RecordBatch.from_arrays([rows.column("g").combine_chunks().take(at), rows.column("c").combine_chunks().take(at),
                                          pa.array(l[hit].astype(np.int32)), pa.array(r[hit].astype(np.int32))], ["g", "c", "l", "r"])
    return run


def _band_rows(contexts: DataFrame, width: int, length: int, gram: int) -> DataFrame:
    """Bands of ``width`` offsets inside each context's range [lo, hi]: band,
    what all its windows see (mid), what any sees (ext), its first and last offset."""
    hashed = lambda b: int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, c, n, suffix, left, bands in zip(*(x.to_pylist() for x in batch.columns)):
                back = left[::-1]
                text, zero = back + suffix, len(back)
                for lo, hi in bands:
                    for band in range(lo // width, hi // width + 1):
                        a, b = max(lo, band * width), min(hi, band * width + width - 1)
                        first, last = max(a, length - len(suffix)), min(b, zero)
                        if first <= last:
                            mid = text[zero - a:zero + length - b]
                            ext = b"%d %d " % (first, last) + text[zero - last:zero + length - first]
                            out.append((g, c, n, a, b, first, last, hashed(mid), hashed(ext)))
            cols = list(zip(*out)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["g", "c", "n", "a", "b", "first", "last", "mid", "ext"])

    return contexts.select("g", "c", "n", "suffix", "left", "bands").mapInArrow(
        run, "g long, c long, n long, a long, b long, first long, last long, mid long, ext long")


def _by_bands(contexts: DataFrame, length: int, gram: int) -> DataFrame | None:
    """Step 3: (g, c, l, r) for contexts (g, c, n, suffix, left) of large grams."""
    now = contexts.withColumn("bands", F.array(F.array(F.lit(0), F.lit(length - gram))))
    found = None
    for width in BANDS:
        rows = written(_band_rows(now, width, length, gram), "suffix_bands")
        same = rows.groupBy("g", "a", "b", "mid", "ext").agg(F.sum("n").alias("times"), F.min("c").alias("one"))
        mids = (same.groupBy("g", "a", "b", "mid").agg(F.count("*").alias("kinds"), F.min("times").alias("least"))
                .where("kinds > 1 and least = 1"))
        rows = rows.join(written(same, "suffix_same"), ["g", "a", "b", "mid", "ext"])
        done = rows.where("times > 1").select("g", "c", "first", "last")
        found = done if found is None else found.unionByName(done)
        if width == 1:
            break
        # of contexts that are covered in the band, one can stand for all
        left = (rows.where("times = 1 or c = one").join(mids, ["g", "a", "b", "mid"])
                .groupBy("g", "c").agg(F.collect_set(F.array("a", "b")).alias("bands")))
        left = written(left, "suffix_open")
        if left.isEmpty():
            break
        now = contexts.join(left, ["g", "c"])
    return found.groupBy("g", "c").agg(F.max("last").cast("int").alias("l"), (length - F.min("first")).cast("int").alias("r"))


def _contexts(docs: DataFrame, wanted: DataFrame, text_col: str, length: int, cuts: np.ndarray, share: int = 1) -> DataFrame:
    """The bytes of wanted contexts (t, at, g, c, n, lead): suffix, and what is to the left, reversed; and the bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "text"):
            raw = [x.as_py() for x in batch.column(0).cast(pa.binary())]
            lists = batch.column(1)
            owner = np.repeat(np.arange(len(raw)), np.asarray(lists.value_lengths())).tolist()
            places = lists.flatten()
            at = np.asarray(places.field("at"))
            place, left, right = (at >> 20).tolist(), (at >> 10 & 1023).tolist(), (at & 1023).tolist()
            suffixes = [raw[i][a:a + r] for i, a, r in zip(owner, place, right)]
            before = [raw[i][a - l:a][::-1] for i, a, l in zip(owner, place, left)]
            for k in range(0, len(owner), 2000):
                own = places.slice(k, 2000)
                bucket = bucket_of(np.asarray(own.field("lead")), np.asarray(own.field("g")), cuts, share).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(own.field(x) for x in ("g", "c", "n")), pa.array(bucket), pa.array(suffixes[k:k + 2000], pa.binary()),
                                                  pa.array(before[k:k + 2000], pa.binary())], ["g", "c", "n", "bucket", "suffix", "left"])

    text = _text(docs, text_col)
    places = wanted.groupBy("t").agg(F.collect_list(F.struct("at", "g", "c", "n", "lead")).alias("places"))
    texts = docs.where(F.octet_length(text) >= length).select(F.xxhash64(text).alias("t"), text.alias("text"))
    texts = _having(texts, wanted.select("t")).groupBy("t").agg(F.first("text").alias("text"))
    return texts.join(places, "t").select("text", "places").mapInArrow(run, "g long, c long, n long, bucket int, suffix binary, left binary")


def _having(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose name t is among ``names``: a broadcast if there are few enough, else all rows go on to the join."""
    names = written(names.distinct(), "suffix_names")
    return texts.join(F.broadcast(names), "t", "left_semi") if names.count() <= MAX_IDS else texts


def _splitters(wanted: DataFrame, ranges: int) -> np.ndarray:
    """Quantiles of the suffixes' leading bytes (a sketch of bounded size)."""
    cuts = wanted.agg(F.percentile_approx("lead", [i / ranges for i in range(1, ranges)], F.lit(10 * ranges))).first()[0] if ranges > 1 else None
    return np.array(cuts or [], np.int64)


def bucket_of(lead: np.ndarray, g: np.ndarray, cuts: np.ndarray, share: int) -> np.ndarray:
    """The bucket of each suffix: its range among the splitters (where one
    value is several splitters, one of their ranges, by the gram), and one of
    ``share`` parts of that range by the gram."""
    lo, hi = np.searchsorted(cuts, lead, "left"), np.searchsorted(cuts, lead, "right")
    g = X.mix(g.astype(np.int64).view(np.uint64))
    at = np.where(hi > lo, lo + 1 + (g % np.maximum(hi - lo, 1).astype(np.uint64)).astype(np.int64), hi)
    return at * share + (g >> np.uint64(32)).astype(np.int64) % share


def covered(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP,
            bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(t, spans): for every text (named by its hash) with covered bytes, the covered intervals, which may overlap."""
    spark = docs.sparkSession
    found = written(anchors(docs, text_col, length, gram), "suffix_anchors")
    grams = found.groupBy("g").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed")).where("n > 1").select("g", "mixed")
    grams = written(grams, "suffix_grams")
    repeated = found.join(F.broadcast(grams) if grams.count() <= MAX_GRAMS else grams, "g")
    shared = repeated.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("t", "at")).alias("one"), F.first("lead").alias("lead"), F.first("mixed").alias("mixed"))
    shared = written(shared.select("g", "c", "n", "one.t", "one.at", "lead", "mixed"), "suffix_shared")
    cover = shared.where("n > 1").select("g", "c", F.shiftright("at", 10).bitwiseAND(F.lit(1023)).cast("int").alias("l"),
                                         F.col("at").bitwiseAND(F.lit(1023)).cast("int").alias("r"))
    sizes = shared.where("mixed").groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("least = 1").select("g", "m")
    sizes = written(sizes, "suffix_sizes")
    wanted = written(shared.where("mixed").join(F.broadcast(sizes) if sizes.count() <= MAX_GRAMS else sizes, "g"), "suffix_wanted")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-wanted.count() // bucket_rows))
    ranges = min(parts, MAX_RANGES)
    share = -(-parts // ranges)
    once = shared.where("mixed and n = 1").select("g", "c")
    small = wanted.where(F.col("m") <= group)
    small = _contexts(docs, small, text_col, length, _splitters(small, ranges), share).repartitionById(ranges * share, F.col("bucket"))
    resolved = small.select("g", "c", "suffix", "left").mapInArrow(_buckets(length, gram), "g long, c long, l int, r int")
    cover = cover.unionByName(resolved.join(once, ["g", "c"], "left_semi"))
    large = wanted.where(F.col("m") > group)
    if not large.isEmpty():
        contexts = written(_contexts(docs, large, text_col, length, np.zeros(0, np.int64)).drop("bucket"), "suffix_contexts")
        cover = cover.unionByName(_by_bands(contexts, length, gram).join(once, ["g", "c"], "left_semi"))
    place = F.shiftright("at", 20)
    return (repeated.join(written(cover, "suffix_cover"), ["g", "c"]).select("t", (place - F.col("l")).alias("a"), (place + F.col("r")).alias("b"))
            .groupBy("t").agg(F.collect_set(F.struct("a", "b")).alias("spans")))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *[b for _, b in runs]]
    return b"".join(raw[a:b] for a, b in zip(ends, [*[a for a, _ in runs], len(raw)]))


def _touched(docs: DataFrame, text_col: str, found: str, words: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Documents with covered bytes (their spans in the column ``found``), and all others.
    With ``words``, repeated runs of that many words are covered too, however few bytes they have."""
    spans = covered(docs, text_col, **options)
    if words:
        spans = (spans.unionByName(passages.covered(docs, text_col, words))
                 .groupBy("t").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    return _with_spans(docs, text_col, found, written(spans, "suffix_spans"))


def _with_spans(docs: DataFrame, text_col: str, found: str, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents whose text has a row in the written table (t, spans), with it as the column ``found``; and all others."""
    t = X.fresh(docs, "_text_name")
    named = docs.withColumn(t, F.xxhash64(_text(docs, text_col)))
    spans = spans.select(F.col("t").alias(t), F.col("spans").alias(found))
    if spans.count() <= MAX_IDS:   # untouched texts need no shuffle
        names = F.broadcast(spans.select(t))
        return named.join(names, t, "left_semi").join(spans.hint("shuffle_hash"), t).drop(t), named.join(names, t, "left_anti").drop(t)
    both = named.join(spans.hint("shuffle_hash"), t, "left").drop(t)
    return both.where(F.col(found).isNotNull()), both.where(F.col(found).isNull()).drop(found)


def _length(runs: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in runs)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = passages.WORDS, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; and what
    repeated runs of ``words`` words cover, which nothing is removed for: n_passage_bytes, in_passage."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = covered(docs, "text", **options).select("t", "spans", F.lit(None).alias("passages"))
    runs = passages.covered(docs, "text", words).select("t", F.lit(None).alias("spans"), F.col("spans").alias("passages"))
    both = cut.unionByName(runs).groupBy("t").agg(F.struct(F.first("spans", True).alias("spans"), F.first("passages", True).alias("passages")).alias("spans"))
    touched, rest = _with_spans(docs, "text", "_spans", written(both, "suffix_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "text"):
            out = []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
                raw, runs = text.as_py() or b"", merged(found["spans"] or [])
                within = _length(merged(found["passages"] or []))
                out.append((len(raw), _length(runs), len(runs), hashlib.sha256(_cut(raw, runs)).hexdigest(), within, within > 0))
            a, b, c, d, e, f = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d),
                                              pa.array(e, pa.int64()), pa.array(f)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "in_passage"])

    text, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    whole = rest.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
                        F.sha2(text, 256).alias("kept_sha256"), none.alias("n_passage_bytes"), F.lit(False).alias("in_passage"))
    return whole.unionByName(touched.select("doc_id", "text", "_spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, in_passage boolean"))


def dedup(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents and columns, covered bytes cut from the text.  Bytes of
    a character that a cut leaves incomplete go too, so the text stays text.
    With the option ``words``, repeated runs of that many words are cut as well."""
    found, cut_col = X.fresh(docs, "_spans"), X.fresh(docs, "_cut")
    touched, rest = _touched(docs, text_col, found, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, cut_col):
            at = batch.schema.get_field_index(cut_col)
            texts = [_cut(text.as_py() or b"", merged(spans)).decode("utf-8", "ignore")
                     for text, spans in zip(batch.column(at).cast(pa.binary()), batch.column(at + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], batch.schema.names[:at + 1])

    others = [c for c in docs.columns if c != text_col]
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != text_col)
    cut = touched.select(*others, F.col(text_col).alias(cut_col), found).mapInArrow(run, f"{shape}`{cut_col}` string")
    return rest.select(*docs.columns).unionByName(cut.withColumnRenamed(cut_col, text_col).select(*docs.columns))
