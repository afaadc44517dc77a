"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut into segments that no piece crosses (before a run of
blanks, and before a line break, which no piece contains).  The distinct segments that were not
met before are concatenated and indexed: all byte positions sorted by what
follows (a suffix array, as deep as the longest piece).  Binary search finds
for every piece of the vocabulary the range of its occurrences; each
occurrence is an edge from its first position to the position after it.  Edges
are sorted by the position they end at and relaxed in that order.

Relaxing gives exactly the tokens of byte-pair merging: for each position the
last token of the text before it is the one edge whose piece can follow the
last token at the edge's start.  Two tokens can stand side by side if undoing
their merges, the later one first, never shows a pair at their border that
merging would have joined before.  Characters without a piece become byte
pieces.  The first segment gets a blank before it, as the model asks for.

Tasks keep one entry for each distinct segment they met (emptied at
``KEPT`` entries); long texts are encoded whole.

Edge cases: null and empty texts have no tokens; a null id stays null; repeated
rows are encoded alike; U+2581 is the model's own blank and decodes as a blank
(``round_trip`` is false there, true for every other text); empty tables give
no rows; other columns are ignored or carried along if named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm import textops as X

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
KEPT = 250_000
CHUNK = 1 << 17              # bytes of new segments indexed at once
BLANK = "▁"
FIRST_PIECE = 259            # ids before it: unknown, begin, end, 256 bytes
BYTE = 3                     # id of byte 0
SEGMENT = re.compile(rb" +[^ \n]*|\n[^ \n]*")


def merge(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Byte-pair merging of a short string: always the neighbours whose joined
    piece ranks first, the leftmost of equals.  Also the last pair joined."""
    symbols, last = list(symbols), None
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
        if best is None:
            return symbols, last
        i = best[1]
        last = (symbols[i], symbols[i + 1])
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]


def vocabulary(model_file: str = MODEL) -> dict:
    """Tables of the model (bounded by its vocabulary) that tasks need."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.vocab_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    ids = {p: i for i, p in enumerate(pieces) if i >= FIRST_PIECE}
    rank = {p: int(-model.get_score(i)) for p, i in ids.items() if len(p) > 1}
    if any("\n" in p or BLANK in p.lstrip(BLANK) for p in ids) or any(c not in ids for p in ids for c in p):
        raise ValueError("a piece crosses segments, or has a character that is no piece")
    order = np.full(size, -1, np.int64)
    left, right = np.zeros(size, np.int64), np.zeros(size, np.int64)
    usable = np.zeros(size, bool)
    for p, i in ids.items():
        if len(p) == 1:
            usable[i] = True
            continue
        whole, last = merge(list(p), rank)
        order[i] = rank[p]
        if len(whole) == 1:
            usable[i], left[i], right[i] = True, ids[last[0]], ids[last[1]]
    if any(order[left[i]] > order[i] or order[right[i]] > order[i] for i in np.flatnonzero(usable & (order >= 0))):
        raise ValueError("a piece is joined from parts that rank after it")
    pairs = sorted((ids[p[:k]] << 20 | ids[p[k:]], rank[p]) for p in rank for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
    surface = [bytes([i - BYTE]) if BYTE <= i < FIRST_PIECE else p.replace(BLANK, " ").encode() if i >= FIRST_PIECE else b"" for i, p in enumerate(pieces)]
    return {"surface": surface, "usable": usable, "single": np.array([len(p) == 1 and i >= FIRST_PIECE for i, p in enumerate(pieces)]),
            "order": order, "left": left, "right": right,
            "pairs": np.array([p for p, _ in pairs], np.int64), "pair_rank": np.array([r for _, r in pairs], np.int64)}


class Encoder:
    """Encodes segments; one per task."""

    def __init__(self, tables: dict):
        self.__dict__.update(tables)
        self.length = np.array([len(s) for s in self.surface], np.int64)
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.at = np.cumsum(self.length) - self.length
        used = np.flatnonzero(self.usable)
        self.short = used[self.length[used] <= 8]
        self.long = used[self.length[used] > 8]
        pad = lambda s, fill: int.from_bytes(s[:8].ljust(8, fill), "big")
        self.low = np.array([pad(self.surface[i], b"\x00") for i in self.short], np.uint64)
        self.high = np.array([pad(self.surface[i], b"\xff") for i in self.short], np.uint64)
        self.long_start = np.unique(np.array([pad(self.surface[i], b"\x00") for i in self.long], np.uint64))
        self.depth = max(8, int(self.length.max()))
        self.memo_key = np.full(1 << 21, -1, np.int64)
        self.memo = np.zeros(1 << 21, bool)
        self.places: dict[bytes, int] = {}
        self.ids, self.bounds = [], [0]
        self._flat = None

    def can_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a and b side by side."""
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= FIRST_PIECE) & (b >= FIRST_PIECE))
        a, b = a[live], b[live]
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            key = a << 20 | b
            i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined = (self.pairs[i] == key) & (self.pair_rank[i] < limit)
            ok[live[joined]] = False
            ra, rb = self.order[a], self.order[b]
            go = ~joined & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return ok

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``can_follow`` with a memory of pairs already decided."""
        key = a << 20 | b
        slot = (key * 0x9E3779B1 >> 11) & (len(self.memo) - 1)
        new = np.flatnonzero(self.memo_key[slot] != key)
        if len(new):
            fresh, place = np.unique(key[new], return_inverse=True)
            value = self.can_follow(fresh >> 20, fresh & ((1 << 20) - 1))
            out = self.memo[slot]
            out[new] = value[place]
            self.memo_key[slot[new]], self.memo[slot[new]] = key[new], out[new]
            clash = new[self.memo_key[slot[new]] != key[new]]  # another pair took the slot: leave it empty
            self.memo_key[slot[clash]] = -1
            return out
        return self.memo[slot]

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of every piece in ``data``."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(self.depth + 8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = key << np.uint64(8) | padded[j:n + j]
        suffixes = np.argsort(key, kind="stable")
        ordered = key[suffixes]
        lo, hi = np.searchsorted(ordered, self.low), np.searchsorted(ordered, self.high, side="right")
        times = hi - lo
        at = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
        starts, pieces = [suffixes[at]], [np.repeat(self.short, times)]
        deep = suffixes[np.isin(ordered, self.long_start)]
        if len(deep):
            deeper = padded[deep[:, None] + np.arange(self.depth)].copy().view(f"S{self.depth}").ravel()
            order = np.argsort(deeper, kind="stable")
            deep, deeper = deep[order], deeper[order]
            wanted = [self.surface[i] for i in self.long]
            lo = np.searchsorted(deeper, np.array(wanted, f"S{self.depth}"))
            hi = np.searchsorted(deeper, np.array([s.ljust(self.depth, b"\xff") for s in wanted], f"S{self.depth}"), side="right")
            times = hi - lo
            at = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
            starts.append(deep[at])
            pieces.append(np.repeat(self.long, times))
        return np.concatenate(starts), np.concatenate(pieces)

    def encode_new(self, segments: list[bytes]) -> None:
        """Encode distinct segments and keep their ids."""
        size = np.array([len(s) for s in segments], np.int64)
        data = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8)
        begin = np.cumsum(size + 1) - size - 1
        end = begin + size
        starts, pieces = self.edges(data)
        # characters without a piece: a chain of byte pieces
        has = np.zeros(len(data) + 1, bool)
        has[starts[self.single[pieces]]] = True
        lead = (data & 0xC0) != 0x80
        lead[end] = True
        character = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        missing = ~has[character]
        missing[end] = False
        lost = np.flatnonzero(missing)
        starts, pieces = np.concatenate([starts, lost]), np.concatenate([pieces, data[lost].astype(np.int64) + BYTE])
        stops = starts + self.length[pieces]
        offset = stops - np.repeat(begin, size + 1)[starts]
        if len(offset) and offset.max() < 1 << 16:
            offset = offset.astype(np.uint16)
        order = np.argsort(offset, kind="stable")
        starts, pieces, stops, offset = starts[order], pieces[order], stops[order], offset[order]
        cuts = np.flatnonzero(np.concatenate([[True], offset[1:] != offset[:-1], [True]])) if len(offset) else np.zeros(1, np.int64)
        last = np.full(len(data) + 1, -2, np.int64)
        back = np.zeros(len(data) + 1, np.int64)
        last[begin] = -1
        for a, b in zip(cuts[:-1], cuts[1:]):
            before = last[starts[a:b]]
            good = np.flatnonzero(before != -2) + a
            before = last[starts[good]]
            free = (before < FIRST_PIECE) | (pieces[good] < FIRST_PIECE)
            ask = np.flatnonzero(~free)
            if len(ask):
                free[ask] = self._allowed(before[ask], pieces[good[ask]])
            good = good[free]
            last[stops[good]] = pieces[good]
            back[stops[good]] = starts[good]
        # walk back from every end, one token of every segment a step
        steps, live, now = [], np.arange(len(segments)), end.copy()
        while True:
            on = now > begin[live]
            live, now = live[on], now[on]
            if not len(live):
                break
            steps.append((live, last[now]))
            now = back[now]
        count = np.zeros(len(segments), np.int64)
        for live, _ in steps:
            count[live] += 1
        stop = np.cumsum(count)
        ids = np.zeros(int(stop[-1]) if len(stop) else 0, np.int32)
        for k, (live, tokens) in enumerate(steps):
            ids[stop[live] - 1 - k] = tokens
        base = self.bounds[-1]
        for i, s in enumerate(segments):
            self.places[s] = len(self.bounds) - 1 + i
        self.ids.append(ids)
        self.bounds += (base + stop).tolist()
        self._flat = None

    def learn(self, segments: set[bytes]) -> None:
        fresh = [s for s in segments if s not in self.places]
        at = 0
        while at < len(fresh):
            size, to = 0, at
            while to < len(fresh) and (size < CHUNK):
                size += len(fresh[to]) + 1
                to += 1
            self.encode_new(fresh[at:to])
            at = to

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their offsets."""
        if len(self.places) > KEPT:
            self.places, self.ids, self.bounds, self._flat = {}, [], [0], None
        cut = [SEGMENT.findall(b" " + t.replace(BLANK.encode(), b" ")) if t else [] for t in texts]
        self.learn({s for c in cut for s in c})
        if self._flat is None:
            self._flat = np.concatenate([*self.ids, np.zeros(0, np.int32)]), np.array(self.bounds, np.int64)
            self.ids = [self._flat[0]]
        flat, bounds = self._flat
        get = self.places.__getitem__
        index = np.array([i for c in cut for i in map(get, c)], np.int64)
        size = bounds[index + 1] - bounds[index]
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(bounds[index] - total[:-1], size) + np.arange(total[-1])
        return flat[at], total[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts (each without its first blank), and their offsets."""
        size = self.length[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.flat[np.repeat(self.at[ids] - total[:-1], size) + np.arange(total[-1])]
        bounds = total[offsets]
        blank = np.flatnonzero(bounds[1:] > bounds[:-1])
        drop = bounds[:-1][blank][out[bounds[:-1][blank]] == 32]
        gone = np.zeros(len(bounds), np.int64)
        gone[1:] = np.searchsorted(drop, bounds[1:])
        return np.delete(out, drop), bounds - gone


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL, keep: tuple[str, ...] = (),
           tables: dict | None = None) -> DataFrame:
    """doc_id, the columns in ``keep``, n_tokens, ids, and round_trip: whether
    the ids decode to the very text."""
    shared = docs.sparkSession.sparkContext.broadcast(tables or vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in X.slices(batches, "text"):
            data, bounds = X.text_bytes(batch.column(batch.num_columns - 1))
            raw = data.tobytes()
            ids, offsets = encoder.encode([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
            back, at = encoder.decode(ids, offsets)
            whole = back.tobytes()
            same = [whole[a:b] == raw[c:d] for a, b, c, d in zip(at[:-1], at[1:], bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array(same)],
                [*batch.schema.names[:-1], "n_tokens", "ids", "round_trip"])

    docs = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{shape}, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_file: str = MODEL, tables: dict | None = None) -> DataFrame:
    """doc_id, text."""
    shared = encoded.sparkSession.sparkContext.broadcast(tables or vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            ids = np.asarray(lists.flatten(), np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
            data, at = encoder.decode(ids, offsets)
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
