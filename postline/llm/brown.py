"""Language-model scores from Brown classes.

Tokens are words (anything but ASCII white space, A-Z lower-cased), then one end of
text.  The model is a class bigram: P(w | v) = P(class w | class v) *
P(w | class w), with an end of text before the first word.

Every word has a class, seen in training or not.  The ``WORDS`` most frequent words
(that occur ``UNIT_COUNT`` times at least) are units of their own; any other word belongs to the unit of its last three bytes
(``ENDINGS`` of them).  Units, not single rare words, are clustered, so the model
has a fixed size, while counts cover all words of the corpus.

Exchange clustering: all units start in a class by rank; a round counts
for each unit the classes before and after it over the whole training corpus
(summed per task, then per block of units, in two steps), and one pass over the units moves each to the
class that raises the likelihood of the class bigrams most.  That pass is one task:
its input has the size of the model, not of the corpus.

Smoothing: transitions fall back on the class's own share with the weight of
``PRIOR`` tokens; a word of a class has (count + 0.5) of the class's tokens
plus half of its distinct words and of one unseen word.  The base score is the smoothed unigram.

Scale: counts are summed per task before they are shuffled.  The ``KNOWN`` most
frequent words (at most; a bounded table) are scored where the text is; only rarer
words travel, as (text, word, times), to be joined with the counts, so no
hot word is a join key.  Words are named by 64-bit hashes.

Edge cases: null and empty texts are one end of text; null ids stay null; with
no training text all counts are 0 and every score is that of an empty model;
repeated rows are counted as often as they occur; ties in rank go by the word's
hash; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline.llm import textops as X
from postline.session import written

CLASSES = 64
WORDS = 28_672
UNIT_COUNT = 20              # times that a unit of its own occurs in training at least
ENDINGS = 4_096
KNOWN = 1 << 18
ROUNDS = 6
PRIOR = 2.0
TOKENS_AT_ONCE = 1 << 20
BLOCK = 512                  # units counted in one row of the shuffle
SEED = 3
END = 0                      # name of the end of text


class Tokens:
    """Word names and endings of texts; one per task."""

    def __init__(self):
        self.hasher = X.Hasher(SEED)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of all tokens (each text followed by END), their ending
        (0 .. ENDINGS-1), and the offsets of the texts."""
        data, offsets = X.text_bytes(column)
        starts, ends, first = X.word_spans(data, offsets, X.WORD)
        names = self.hasher.words(data, starts, ends)
        names[names == END] = 1
        tail = np.zeros(len(starts), np.uint64)
        for k in (1, 2, 3):
            byte = X.LOWER[data[np.maximum(ends - k, 0)]] if len(data) else np.zeros(0, np.uint8)
            tail = tail << np.uint64(8) | np.where(ends - k >= starts, byte, 0).astype(np.uint64)
        tail = (X.mix(tail + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64)
        texts = np.arange(len(first) - 1)
        at = first[1:] + texts                  # places of the ends
        out, endings = np.zeros(len(names) + len(texts), np.uint64), np.zeros(len(names) + len(texts), np.int64)
        word = np.ones(len(out), bool)
        word[at] = False
        out[word], endings[word] = names, tail
        return out, endings, first + np.arange(len(first))


def _pairs(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = np.concatenate([f[0] for f in found])
    order = np.argsort(names)
    names = names[order]
    new = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    times = np.add.reduceat(np.concatenate([f[1] for f in found])[order], new)
    return names[new], times, np.concatenate([f[2] for f in found])[order][new]


def count_words(texts: DataFrame) -> DataFrame:
    """(word, ending, n) over all texts; task-wise sums first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kept, size = Tokens(), [], 0

        def emit(found):
            names, times, endings = _pairs(found)
            for i in range(0, len(names), 1 << 16):
                yield pa.RecordBatch.from_arrays([X.int64(names[i:i + (1 << 16)]), pa.array(endings[i:i + (1 << 16)].astype(np.int32)),
                                                  pa.array(times[i:i + (1 << 16)])], ["word", "ending", "n"])

        for batch in X.slices(batches, "text"):
            names, endings, _ = tokens.of(batch.column(0))
            kept.append(_pairs([(names, np.ones(len(names), np.int64), endings)]))
            size += len(kept[-1][0])
            if size > 2_000_000:
                kept = [_pairs(kept)]
                size = len(kept[0][0])
                if size > 1_500_000:
                    yield from emit(kept)
                    kept, size = [], 0
        if kept:
            yield from emit(kept)

    return (texts.select("text").mapInArrow(run, "word long, ending int, n long")
            .groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n")))


def frequent(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """(word, n) of all words from the smallest count (on a scale of eight
    steps for each power of two) that leaves at most ``most`` of them, most frequent first."""
    step = F.floor(F.log2("n") * 8).cast("int")
    scale = counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).orderBy(F.desc("s")).collect()
    least, total = None, 0
    for row in scale:
        total += row["k"]
        if total > most:
            break
        least = row["s"]
    if least is None:
        return []
    found = counts.where(step >= least).select("word", "n").toArrow()
    return sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist()), key=lambda x: (-x[1], x[0]))


class Units:
    """Units of words, from the frequent words; one per task."""

    def __init__(self, names: np.ndarray, units: np.ndarray, first_ending: int):
        self.names, self.units, self.first_ending = names, units, first_ending

    def of(self, names: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each token, and its place among the known words (-1: rare)."""
        if not len(self.names):
            return endings + self.first_ending, np.full(len(names), -1)
        place = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        known = self.names[place] == names
        unit = np.where(known, self.units[place], -1)
        return np.where(unit >= 0, unit, endings + self.first_ending), np.where(known, place, -1)


def _sequences(texts: DataFrame, shared) -> DataFrame:
    """Unit numbers of all tokens, text after text (16 bits each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, units = Tokens(), Units(*shared.value)
        for batch in X.slices(batches, "text"):
            names, endings, _ = tokens.of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([units.of(names, endings)[0].astype(np.uint16).tobytes()], pa.binary())], ["units"])
    return texts.select("text").mapInArrow(run, "units binary")


def _context_counts(sequences: DataFrame, classes: np.ndarray, n_units: int, end: int, n_classes: int, shares: int) -> DataFrame:
    """Per task (each in one of ``shares`` shares) and block of units: how often a unit has each class before
    and after it (sparse), and the class bigrams of the task (in every block's row)."""
    shared = sequences.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(np.int64)
        width = 2 * n_classes
        seen, bigrams, any_ = np.zeros(n_units * width, np.int32), np.zeros(n_classes * n_classes, np.int64), False
        kept: list[np.ndarray] = []

        def count():    # every row ends with an end of text, so rows can stand one after another
            nonlocal seen, bigrams
            u = np.concatenate([np.full(1, end, np.uint16), *kept]).astype(np.int64)
            kept.clear()
            c = of[u]
            for i in range(0, len(u) - 1, TOKENS_AT_ONCE):
                to = min(i + TOKENS_AT_ONCE, len(u) - 1)
                a, b = slice(i, to), slice(i + 1, to + 1)
                seen += np.bincount(u[b] * width + c[a], minlength=len(seen)).astype(np.int32)
                seen += np.bincount(u[a] * width + n_classes + c[b], minlength=len(seen)).astype(np.int32)
                bigrams += np.bincount(c[a] * n_classes + c[b], minlength=len(bigrams))

        for batch in batches:
            for raw in batch.column(0):
                any_ = True
                kept.append(np.frombuffer(raw.as_py(), np.uint16))
                if sum(map(len, kept)) >= TOKENS_AT_ONCE:
                    count()
        if kept:
            count()
        if any_:
            # frequent units come first by number: dealing them out in turn fills the blocks alike
            blocks = -(-n_units // BLOCK)
            by_unit = seen.reshape(n_units, width)
            part = TaskContext.get().partitionId() % shares
            for block in range(blocks):
                own = by_unit[block::blocks].ravel()
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                                                  pa.array([own[at].astype(np.int64).tobytes()], pa.binary()), pa.array([bigrams.tobytes()], pa.binary())],
                                                 ["block", "share", "at", "n", "bigrams"])
    return sequences.mapInArrow(run, _COUNTS)


_COUNTS = "block int, share int, at binary, n binary, bigrams binary"


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(a: int, before: np.ndarray, after: np.ndarray, bigrams: np.ndarray, sizes: np.ndarray) -> tuple[int, float]:
    """The class that suits a unit of class a best, and how much better than a it is (natural log)."""
    rows, cols, n = np.flatnonzero(before), np.flatnonzero(after), after.sum()
    into, out = bigrams[rows], bigrams[:, cols]     # copies without the unit
    into[:, a] -= before[rows]
    into[rows == a] -= after
    out[a] -= after[cols]
    out[:, cols == a] -= before[:, None]
    np.maximum(into, 0, out=into)
    np.maximum(out, 0, out=out)
    size = sizes.copy()
    size[a] = max(size[a] - n, 0)
    gain = ((_xlogx(into + before[rows, None]) - _xlogx(into)).sum(0) + (_xlogx(out + after[cols]) - _xlogx(out)).sum(1)
            - 2 * (_xlogx(size + n) - _xlogx(size)))
    # a class's bigram with itself gets both sides at once
    itself = bigrams.diagonal().copy()
    itself[a] = max(itself[a] - before[a] - after[a], 0)
    gain += _xlogx(itself + before + after) - _xlogx(itself + before) - _xlogx(itself + after) + _xlogx(itself)
    b = int(gain.argmax())
    return b, float(gain[b] - gain[a])


def exchange(classes: np.ndarray, blocks: Iterator[tuple[int, int, np.ndarray]], bigrams: np.ndarray, fixed: int) -> np.ndarray:
    """One round of the exchange: units in turn, each to its best class.  The
    bigrams follow every move at once; the counts around a unit are those of
    the round's start.  Class 0 stays the class of the ``fixed`` unit."""
    classes, n_classes = classes.copy(), len(bigrams)
    bigrams = bigrams.astype(float)
    for first, step, seen in blocks:
        seen = seen.reshape(-1, 2 * n_classes)
        for i in np.flatnonzero(seen.any(1)):
            unit = first + step * int(i)
            a, before, after = int(classes[unit]), seen[i, :n_classes], seen[i, n_classes:]
            if unit == fixed:
                continue
            b, better = best_class(a, before, after, bigrams, bigrams.sum(1))
            if b and better > 1e-9:
                bigrams[:, a] -= before
                bigrams[a] -= after
                bigrams[:, b] += before
                bigrams[b] += after
                np.maximum(bigrams, 0, out=bigrams)
                classes[unit] = b
    return classes


def _summed(counted: DataFrame, n_classes: int, *keys: str) -> DataFrame:
    """Counts summed over all rows with equal keys: one row each, in the same form."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, width = None, None, 2 * n_classes

        def row():
            at = np.flatnonzero(total[1])
            return pa.RecordBatch.from_arrays([pa.array([total[0][0]], pa.int32()), pa.array([total[0][1]], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                                               pa.array([total[1][at].tobytes()], pa.binary()), pa.array([total[2].tobytes()], pa.binary())],
                                              ["block", "share", "at", "n", "bigrams"])

        for batch in batches:
            for block, share, at, n, pairs in zip(*(x.to_pylist() for x in batch.columns)):
                key = (block, share)[:len(keys)]
                if key != now:
                    if now is not None:
                        yield row()
                    now, total = key, ((block, share), np.zeros((BLOCK + 1) * width, np.int64), np.zeros(n_classes * n_classes, np.int64))
                total[1][np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
                total[2][:] += np.frombuffer(pairs, np.int64)
        if now is not None:
            yield row()
    return counted.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _COUNTS)


def _round(summed: DataFrame, classes: np.ndarray, end: int, n_classes: int) -> DataFrame:
    """The units' classes after a round.  One task: its input, the units' counts by
    class, has a fixed size (the model's), whatever the corpus."""
    shared = summed.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(x.to_pylist() for x in batch.columns))]
        if rows:
            bigrams = np.frombuffer(rows[0][4], np.int64).reshape(n_classes, n_classes)

            def dense(at, n):
                out = np.zeros((BLOCK + 1) * 2 * n_classes)
                out[np.frombuffer(at, np.int32)] = np.frombuffer(n, np.int64)
                return out

            step = -(-len(shared.value) // BLOCK)
            blocks = ((block, step, dense(at, n)) for block, _, at, n, _ in sorted(rows))
            yield pa.RecordBatch.from_arrays([pa.array([exchange(shared.value, blocks, bigrams, end).astype(np.int32).tobytes()], pa.binary())], ["classes"])
    return summed.repartition(1).mapInArrow(run, "classes binary")


def cluster(sequences: DataFrame, n_units: int, end: int, n_classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of every unit.  The end of text has a class of its own (0)."""
    classes = (np.arange(n_units) % (n_classes - 1) + 1).astype(np.int32)
    classes[end] = 0
    # tasks' counts are summed in two steps, each over the root of their number
    shares = math.isqrt(sequences.rdd.getNumPartitions()) + 1
    for _ in range(rounds):
        counted = _context_counts(sequences, classes, n_units, end, n_classes, shares)
        summed = _summed(_summed(counted, n_classes, "block", "share"), n_classes, "block")
        moved = _round(summed, classes, end, n_classes).first()
        if moved is None or np.array_equal(found := np.frombuffer(moved[0], np.int32), classes):
            break
        classes = found
    return classes


def class_bigrams(sequences: DataFrame, classes: np.ndarray, end: int, n_classes: int) -> np.ndarray:
    shared = sequences.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, out = shared.value.astype(np.int64), np.zeros(n_classes * n_classes, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                c = of[np.concatenate([[end], np.frombuffer(raw.as_py(), np.uint16)]).astype(np.int64)]
                out += np.bincount(c[:-1] * n_classes + c[1:], minlength=len(out))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at])], ["pair", "n"])

    summed = sequences.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n_classes * n_classes)
    for row in summed:
        out[row["pair"]] = row["n"]
    return out.reshape(n_classes, n_classes)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", n_classes: int = CLASSES,
          rounds: int = ROUNDS, known_words: int = KNOWN, unit_words: int = WORDS, unit_count: int = UNIT_COUNT) -> DataFrame:
    """Learn from the rows where ``training`` holds; score all rows: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(~training, F.lit(False)).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("not held_out")
    counts = written(count_words(texts), "brown_counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, n_distinct = int(total[0]), int(total[1])

    # the bounded tables: known words and their counts, units, classes
    known = frequent(counts, known_words)
    known_names = np.array([w for w, _ in known], np.int64).view(np.uint64)
    known_counts = np.array([n for _, n in known], np.float64)
    own = [i for i, (w, n) in enumerate(zip(known_names, known_counts)) if w != END and n >= unit_count][:unit_words]
    end, first_ending = len(own), len(own) + 1
    unit = np.full(len(known), -1)
    unit[own] = np.arange(len(own))
    unit[known_names == END] = end
    if not (known_names == END).any():      # hardly any training text: the end is no frequent word
        known_names, known_counts, unit = np.append(known_names, np.uint64(END)), np.append(known_counts, 0.0), np.append(unit, end)
    order = np.argsort(known_names)
    known_names, known_counts, unit = known_names[order], known_counts[order], unit[order]
    n_units = first_ending + ENDINGS
    tables = spark.sparkContext.broadcast((known_names, unit, first_ending))
    sequences = written(_sequences(texts, tables), "brown_sequences")
    classes = cluster(sequences, n_units, end, n_classes, rounds)
    bigrams = class_bigrams(sequences, classes, end, n_classes)

    # distinct words of each class: frequent ones by unit, the others by ending
    own_unit = {int(w): u for w, u in zip(known_names.view(np.int64), unit) if u >= 0}
    distinct = np.zeros(n_classes)
    per_ending = np.zeros(ENDINGS)
    for row in counts.groupBy("ending").agg(F.count("*").alias("k")).collect():
        per_ending[row["ending"]] = row["k"]
    if own_unit:
        names = spark.createDataFrame(pa.table({"word": pa.array(list(own_unit), pa.int64())}))
        for row in counts.join(F.broadcast(names), "word", "left_semi").groupBy("ending").agg(F.count("*").alias("k")).collect():
            per_ending[row["ending"]] -= row["k"]
    np.add.at(distinct, classes[:first_ending], 1)
    np.add.at(distinct, classes[first_ending:], np.maximum(per_ending, 0))

    sizes = bigrams.sum(0)
    share = (sizes + 0.5) / (sizes.sum() + 0.5 * n_classes)
    moves = np.log10((bigrams + PRIOR * share[None, :]) / (bigrams.sum(1, keepdims=True) + PRIOR))
    log_class = np.log10(sizes + 0.5 * (distinct + 1))
    log_all = math.log10(n_all + 0.5 * (n_distinct + 1))
    log_known = np.log10(known_counts + 0.5)
    model = spark.sparkContext.broadcast((known_names, unit, first_ending, known_counts, log_known, classes, moves, log_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit, first_ending, counts_, logs, classes, moves, log_class = model.value
        tokens, units = Tokens(), Units(names, unit, first_ending)
        row = TaskContext.get().partitionId() << 40
        for batch in X.slices(batches, "text"):
            found, endings, offsets = tokens.of(batch.column(2))
            u, place = units.of(found, endings)
            c = classes[u]
            before = np.concatenate([[0], c[:-1]])       # the end of the text before stands for a text's start
            before[offsets[:-1]] = 0
            rare = place < 0
            emission = np.where(rare, 0.0, logs[place])
            model_part = np.add.reduceat(moves[before, c] - log_class[c] + emission, offsets[:-1])
            base_part = np.add.reduceat(emission, offsets[:-1])
            n_known = np.add.reduceat(np.where(rare, 0, counts_[place] > 0).astype(np.int64), offsets[:-1])
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)[rare]
            order = np.lexsort((found[rare], owner))
            owner, words = owner[order], found[rare][order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (words[1:] != words[:-1])])) if len(owner) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(owner)))
            bounds = pa.array(np.searchsorted(owner[new], np.arange(len(n) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(n))), batch.column(0), batch.column(1), pa.array(n), pa.array(n_known), pa.array(base_part), pa.array(model_part),
                 pa.ListArray.from_arrays(bounds, X.int64(words[new])), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32)))],
                ["row", "doc_id", "held_out", "n_tokens", "k", "b", "m", "words", "times"])
            row += len(n)

    parts = written(docs.select("doc_id", "held_out", "text").mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, k long, b double, m double, words array<long>, times array<int>"), "brown_parts")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("p")).select("row", F.col("p.words").alias("word"), F.col("p.times").alias("times"))
    found = (rare.join(counts.select("word", "n"), "word", "left").groupBy("row")
             .agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"),
                  F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).cast("long").alias("rare_known")))
    scored = parts.drop("words", "times").join(found, "row", "left").withColumn("rare_log", F.coalesce("rare_log", F.lit(0.0)))
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("k") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                         F.lit(n_all).cast("long").alias("train_tokens"),
                         (F.col("b") + F.col("rare_log") - F.col("n_tokens") * log_all).alias("base_score"),
                         (F.col("m") + F.col("rare_log")).alias("score"),
                         F.pow(F.lit(10.0), -(F.col("m") + F.col("rare_log")) / F.col("n_tokens")).alias("perplexity"))
