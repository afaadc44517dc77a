"""Token ids in wavelet matrices, one file per shard.

Documents are dealt by range of (id, text name) and encoded in the task that
writes them, in ascending order.  A piece of text that no token crosses is encoded once by a worker
process and remembered; a 64-bit hash finds its other places in a slice.  A task closes a shard when it has ``SHARD_TOKENS``
ids; a document is never split.  Shard names sort in document order.

A shard holds one bit-plane for each bit of the largest id, the highest first.  Each plane orders the
ids stably by the bits above it, as a wavelet matrix does: those with a 0
bit go before those with a 1 bit.  Planes are cut into blocks of ``BLOCK`` bits, compressed one
by one; the directory has each block's place and the number of ones before it.
So one id (``access``), the number of an id in a range (``count``), its k-th
place (``select``) and all its places (``occurrences``) read one block a plane,
or a few, and never the whole file; ``tokens`` rebuilds all ids, plane by plane from the lowest.

File layout, little endian: magic (8 bytes), length of the head (4 bytes), head (JSON: numbers, and the
place of each section), sections: document ids, null marks, document ends,
ones before each block, block places, blocks.  All but the head are zstd frames.

Files are written beside their final name and then moved there, so a task that is run again
replaces its files by equal ones; the manifest (one row a shard) lists
the files that count.  The folder must be one that the driver and all executors share, and
that pyarrow opens (a mounted path, file:, hdfs:, s3:, gs:).

Edge cases: null and empty texts are their end id alone; null ids come first; rows with equal
ids are in order of their text's hash, and rows equal in both are interchangeable; ids are
integers; an empty table gives an empty manifest; other columns are ignored.  A text is one
document in one task, at about twenty times its size in memory.
Read documents from files, or write them first: the deal by range
needs rows that come in the same order when a task is run again.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postline.llm import textops as X
from postline.session import remember_scratch, scratch_path, written

MAGIC = b"WAVELET1"
BLOCK = 1 << 15              # bits of a block
SHARD_TOKENS = 1 << 21       # ids of a shard, at least, but for the last of a task
MEMO = 1_000_000             # pieces whose ids a worker process remembers
SEED = 11
SLICE = 1 << 21             # bytes of text encoded at once
CACHE = 256                  # blocks that a reader keeps
MANIFEST = "shard string, path string, n_docs long, n_tokens long, bytes long"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


# ---------------------------------------------------------------------------
# one file
# ---------------------------------------------------------------------------
def planes_of(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """The bit-planes (packed) and the number of zeros of each."""
    planes, zeros, below = [], [], np.empty_like(ids)
    for k in range(bits - 1, -1, -1):
        ones = (ids & ids.dtype.type(1 << k)).astype(bool)
        planes.append(np.packbits(ones, bitorder="little"))
        zeros.append(len(ids) - int(np.count_nonzero(ones)))
        np.compress(~ones, ids, out=below[:zeros[-1]])
        np.compress(ones, ids, out=below[zeros[-1]:])
        ids, below = below, np.empty_like(ids) if k == bits - 1 else ids
    return planes, zeros


def pack(ids: np.ndarray, ends: np.ndarray, doc_ids: list) -> bytes:
    """The file of a shard: ids (unsigned) of all documents, their ends, their ids."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    planes, zeros = planes_of(ids.astype(np.uint16) if bits <= 16 else ids, bits)
    blocks = -(-len(ids) // BLOCK)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    ones, places, data = np.zeros((bits, blocks + 1), np.uint64), [0], []
    for k, plane in enumerate(planes):
        for b in range(blocks):
            part = plane[b * BLOCK // 8:(b + 1) * BLOCK // 8]
            ones[k, b + 1] = ones[k, b] + np.uint64(np.bitwise_count(part).sum())
            data.append(squeeze(part.tobytes()))
            places.append(places[-1] + len(data[-1]))
    null = np.array([d is None for d in doc_ids], np.uint8)
    parts = {"doc_ids": np.array([0 if d is None else d for d in doc_ids], "<i8"), "null": null, "ends": ends.astype("<u8"),
             "ones": ones.astype("<u8"), "places": np.array(places, "<u8")}
    sections, body = {}, []
    for name, part in parts.items():
        body.append(squeeze(part.tobytes()))
        sections[name] = [sum(map(len, body[:-1])), len(body[-1])]
    sections["blocks"] = [sum(map(len, body)), places[-1]]
    head = json.dumps({"n": len(ids), "bits": bits, "block": BLOCK, "docs": len(doc_ids), "zeros": zeros, "sections": sections}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body, *data])


class Shard:
    """Reads a shard's file; only its head and directory stay in memory."""

    def __init__(self, path: str):
        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        start = self.file.read_at(len(MAGIC) + 4, 0)
        if start[:len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no shard")
        size, = struct.unpack("<I", start[len(MAGIC):])
        head = json.loads(self.file.read_at(size, len(MAGIC) + 4))
        self.n, self.bits, self.block, self.zeros, self.sections = (head[k] for k in ("n", "bits", "block", "zeros", "sections"))
        self.base = len(MAGIC) + 4 + size
        self.ends = self._section("ends", "<u8").astype(np.int64)
        self.doc_ids = [None if no else int(d) for d, no in zip(self._section("doc_ids", "<i8"), self._section("null", np.uint8))]
        self.places = self._section("places", "<u8").astype(np.int64)
        self.ones = self._section("ones", "<u8").astype(np.int64).reshape(self.bits, -1)
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()

    def _read(self, section: str, at: int, size: int) -> bytes:
        return self.file.read_at(size, self.base + self.sections[section][0] + at)

    def _section(self, name: str, kind) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self._read(name, 0, self.sections[name][1])), kind)

    def _bytes(self, plane: int, block: int) -> np.ndarray:
        k = plane * (self.ones.shape[1] - 1) + block
        if k not in self.kept:
            part = self._read("blocks", self.places[k], self.places[k + 1] - self.places[k])
            self.kept[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.uint8)
            if len(self.kept) > CACHE:
                self.kept.popitem(last=False)
        self.kept.move_to_end(k)
        return self.kept[k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, self.block)
        if not rest:
            return int(self.ones[plane, block])
        part = self._bytes(plane, block)
        whole = int(np.bitwise_count(part[:rest >> 3]).sum())
        return int(self.ones[plane, block]) + whole + ((int(part[rest >> 3]) & ((1 << (rest & 7)) - 1)).bit_count() if rest & 7 else 0)

    def _place(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane: the directory gives its block."""
        before = self.ones[plane] if bit else np.minimum(np.arange(self.ones.shape[1]) * self.block, self.n) - self.ones[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._bytes(plane, block), bitorder="little")[:self.n - block * self.block]
        return block * self.block + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane, zeros in enumerate(self.zeros):
            ones = self._ones(plane, i)
            bit = self._ones(plane, i + 1) - ones
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the places start..end of an id stand below the lowest plane."""
        if token < 0 or token >> self.bits:
            return 0, 0
        for plane, zeros in enumerate(self.zeros):
            a, b = self._ones(plane, start), self._ones(plane, end)
            start, end = (zeros + a, zeros + b) if token >> (self.bits - 1 - plane) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id stands at places start..end (rank: start 0)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _up(self, token: int, i: int) -> int:
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            i = self._place(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def select(self, token: int, k: int) -> int:
        """The k-th (from 0) place of an id."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        return self._up(token, a + k)

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> Iterator[int]:
        """All places of an id within start..end, ascending."""
        a, b = self._range(token, start, self.n if end is None else end)
        return (self._up(token, i) for i in range(a, b))

    def tokens(self) -> np.ndarray:
        """All ids."""
        ids, blocks = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32), self.ones.shape[1] - 1
        for plane in range(self.bits - 1, -1, -1):
            packed = np.concatenate([self._bytes(plane, b) for b in range(blocks)]) if blocks else np.zeros(0, np.uint8)
            ones = np.unpackbits(packed, bitorder="little")[:self.n].view(bool)
            above = np.empty_like(ids)
            above[~ones] = ids[:self.zeros[plane]]
            above[ones] = ids[self.zeros[plane]:] | ids.dtype.type(1 << (self.bits - 1 - plane))
            ids = above
        return ids.astype(np.uint32)


# ---------------------------------------------------------------------------
# encoding
# ---------------------------------------------------------------------------
SPACE, LETTER, DIGIT, OTHER = range(4)
#: Class of each byte of a plain text: the tokenizer's pre-tokenizer cuts into runs of letters, single digits and
#: runs of other characters.  Bytes of Latin-1 letters (C3, 80 to BF) are letters.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(9, 14), 32]] = SPACE
CLASS[[*range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = LETTER
CLASS[[*range(0x30, 0x3A)]] = DIGIT
#: What a single apostrophe takes along from the letters after it (fixed values of the pre-tokenizer).
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")
#: Byte-level BPE shows each byte as a character: printable ones as themselves, the others from U+0100 on.
PRINTED = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
SHOWN = {b: chr(b) for b in PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: Pieces that normalising and cutting leave as they are: letters in lower case.
LOWER = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def plain_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts are cut by byte classes: those without characters beyond ASCII but
    Latin-1 letters (lead byte C3, without the signs C3 97 and C3 B7), and without a bar, which
    the special tokens have."""
    odd = (data >= 0xC2) & (data != 0xC3) | (data == 0x7C)
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    at = np.concatenate([[0], np.cumsum(odd)])
    return at[offsets[1:]] == at[offsets[:-1]]


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts (A-Z lower-cased where plain), and start and end of their pieces, which no token
    crosses: of plain texts what the pre-tokenizer cuts, of others words between ASCII white space."""
    plain = np.repeat(plain_texts(data, offsets), np.diff(offsets))
    data = np.where(plain, X.LOWER[data], data)
    kind = CLASS[data]
    kind[~plain & (kind != SPACE)] = OTHER
    begin = np.zeros(len(data) + 4, bool)
    begin[offsets] = True
    edge = begin.copy()                                  # where a text begins, or all end
    begin[0] = True
    begin[1:len(data)] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    quote = np.flatnonzero((data == 0x27) & begin[:len(data)] & plain)
    padded, of = np.concatenate([data, np.zeros(4, np.uint8)]), np.concatenate([kind, np.full(4, SPACE, np.uint8)])
    quote = quote[(of[quote + 1] == LETTER) & ~edge[quote + 1]]
    one = np.isin(padded[quote + 1], np.frombuffer(SHORT, np.uint8))
    pair = padded[quote + 1].astype(np.int64) << 8 | padded[quote + 2]
    two = np.isin(pair, [a << 8 | b for a, b in LONG]) & ~edge[quote + 2]
    for at, size in ((quote[one], 1), (quote[two], 2)):
        begin[at + 1] = False
        rest = at + size + 1
        begin[rest[of[rest] == LETTER]] = True
    begin[len(data)] = True
    bounds = np.flatnonzero(begin[:len(data) + 1])
    whole = kind[bounds[:-1]] != SPACE
    return data, bounds[:-1][whole], bounds[1:][whole]


class Encoder:
    """Ids of texts by a tokenizer file.  Each piece is encoded once and remembered; within a
    slice, a piece's 64-bit hash tells where it occurs again."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(tokenizer_file)
        self.hasher = X.Hasher(SEED, fold=False)
        self._forget()

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {}              # number of each piece
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        bpe, show = self.model.model, SHOWN
        lower = [w for w in new if LOWER.fullmatch(w)]
        found = [[t.id for t in bpe.tokenize(w.decode("latin-1").translate(show))] for w in lower]
        rest = list(set(new).difference(lower))
        found += [e.ids for i in range(0, len(rest), 4096)
                  for e in self.model.encode_batch([w.decode() for w in rest[i:i + 4096]], add_special_tokens=False)]
        size, n = np.array([len(f) for f in found], np.int64), len(self.places)
        total = int(size.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(new) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.ids[self.used:self.used + total] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, total)
        self.begin[n:n + len(new)], self.size[n:n + len(new)] = self.used + np.cumsum(size) - size, size
        self.used += total
        self.places.update(zip(lower + rest, range(n, n + len(new))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as bytes one after another, and the number of ids of each."""
        data, starts, ends = cut(data, offsets)
        raw = data.tobytes()
        _, first, of = np.unique(self.hasher.words(data, starts, ends), return_index=True, return_inverse=True)
        pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        new = [w for w in pieces if w not in self.places]
        if len(self.places) + len(new) > MEMO and self.places:
            self._forget()
            new = pieces
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))[of]
        size = self.size[rows]
        stop = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.begin[rows] - stop[:-1], size) + np.arange(stop[-1])
        return self.ids[at], np.diff(stop[np.searchsorted(starts, offsets)])


_ENCODERS: dict[str, Encoder] = {}      # of this worker process; tasks that follow one another share what it remembers


def _encoder(tokenizer_file: str) -> Encoder:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def write(docs: DataFrame, tokenizer_file: str, end: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents and write the shards into ``folder`` (else a scratch folder of the
    shared checkpoint folder).  The manifest: shard, path, n_docs, n_tokens, bytes, start (ids before it)."""
    spark = docs.sparkSession
    folder = folder or remember_scratch(scratch_path(spark, f"wavelet_{uuid.uuid4().hex}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, (fs, at) = _encoder(tokenizer_file), _open(folder)
        task = TaskContext.get().partitionId()
        done, last = [], np.array([end], np.uint32)
        parts, ids, lengths, size = [], [], [], 0

        def close():
            whole = pack(np.concatenate(parts), np.cumsum(lengths), ids)
            name = f"{task:08d}-{len(done):08d}.wm"
            fs.create_dir(at, recursive=True)
            aside = f"{at}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(aside) as out:
                out.write(whole)
            try:
                fs.move(aside, f"{at}/{name}")
            except OSError:                 # some stores don't replace: an earlier run of this task left an equal file
                if fs.get_file_info(f"{at}/{name}").type != pyarrow.fs.FileType.File:
                    raise
                fs.delete_file(aside)
            done.append((name, f"{folder}/{name}", len(ids), int(size), len(whole)))

        for batch in X.slices(batches, "text", SLICE):
            found, count = encoder.encode(*X.text_bytes(batch.column(1)))
            ends = np.cumsum(count)
            for doc, a, b in zip(batch.column(0).to_pylist(), ends - count, ends):
                parts += [found[a:b], last]
                ids.append(doc)
                lengths.append(b - a + 1)
                size += lengths[-1]
                if size >= shard_tokens:
                    close()
                    parts, ids, lengths, size = [], [], [], 0
        if ids:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], ["shard", "path", "n_docs", "n_tokens", "bytes"])

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), X.text_name(F.col(text_col)).alias("t"),
                        F.monotonically_increasing_id().alias("r"))
    dealt = keyed.repartitionByRange("doc_id", "t", "r").sortWithinPartitions("doc_id", "t", "r").select("doc_id", "text")
    shards = written(dealt.mapInArrow(run, MANIFEST), "wavelet_manifest")
    return shards.withColumn("start", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens"))


def _on_shards(manifest: DataFrame, read, schema: str) -> DataFrame:
    """``read(shard, start)``'s record batches for all shards, each opened by one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from read(Shard(path), start)

    return manifest.select("path", "start").repartition(max(1, manifest.count())).mapInArrow(run, schema)


def read_back(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def read(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        ids = shard.tokens().astype("<u4")
        begin = np.concatenate([[0], shard.ends[:-1]]).astype(np.int64)
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin, shard.ends)]
        yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(begin + start), pa.array(shard.ends - begin), pa.array(crc, pa.int64())],
                                         ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _on_shards(manifest, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def counts(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often the ids occur, by counting in the files."""
    def read(shard: Shard, _: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return _on_shards(manifest, read, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def lookup(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """All places of the ids: token, doc_id, place (in all ids), offset (in the document)."""
    def read(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        for token in tokens:
            found = shard.occurrences(token)
            while len(places := np.fromiter(itertools.islice(found, 4096), np.int64)):
                doc = np.searchsorted(shard.ends, places, side="right")
                begin = np.where(doc > 0, shard.ends[doc - 1], 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), token)), pa.array([shard.doc_ids[d] for d in doc], pa.int64()),
                                                  pa.array(places + start), pa.array(places - begin)], ["token", "doc_id", "place", "offset"])

    return _on_shards(manifest, read, "token long, doc_id long, place long, offset long")


def access(manifest: DataFrame, places: DataFrame, place_col: str = "place") -> DataFrame:
    """(place, token) for places among all ids; places outside give no row.  Each
    place goes to its shard's range by a join on blocks of ``SHARD_TOKENS`` places."""
    spans = manifest.select("path", "start", (F.col("start") + F.col("n_tokens")).alias("end"))
    spans = spans.select("*", F.explode(F.sequence(F.floor(F.col("start") / SHARD_TOKENS), F.floor((F.col("end") - 1) / SHARD_TOKENS))).alias("b"))
    asked = places.select(F.col(place_col).cast("long").alias("place")).withColumn("b", F.floor(F.col("place") / SHARD_TOKENS))
    dealt = asked.join(spans, "b").where("place >= start AND place < end").select("path", "start", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shard = None
        for batch in batches:
            out = []
            for path, start, place in zip(*(c.to_pylist() for c in batch.columns)):
                if path != now:
                    now, shard = path, Shard(path)
                out.append(shard.access(place - start))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.int64())], ["place", "token"])

    return dealt.repartition("path").sortWithinPartitions("path", "place").mapInArrow(run, "place long, token long")
