"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles (words: anything but ASCII white space,
A-Z lower-cased; a text of one to four words is one shingle).  Two texts are
linked if the Jaccard similarity of their sets is ``threshold`` or more.

1. Equal sets are one *node* from the start, whatever the number of copies.
2. A node's set is embedded as ``COORDS`` minimum hashes.  A run starts all
   nodes at one path; at every path each coordinate is chosen with
   probability 1 / (threshold * COORDS), by a hash of the path, and the nodes
   are split by the shared token (their minimum hash) at the chosen coordinates.
   Nodes that share more than ``threshold`` of their tokens stay together on
   some path with a probability that the number of levels gives; runs are repeated
   until the target recall is reached at the threshold itself and at ``MAX_LEVELS``.
3. Buckets of up to ``BUCKET`` nodes are compared by brute force (agreement
   of all coordinates, with a margin below the threshold).  Members of larger ones are compared with
   some of them, the anchors, first; a bucket of which these links make ``FAMILY`` one component is done: the rest is
   linked to it, since step 4 compares components whole.  So a family of near copies isn't split again and again.
   The other buckets are split, down to ``MAX_LEVELS`` shared tokens; what still stays together then is linked to
   its least node.  These candidate links give groups.
4. Within each group all sets are compared exactly, in blocks of about ``BLOCK``
   nodes against ``BLOCK`` nodes, each pair of blocks in a task of its own.  Every
   link is counted, pairs are never emitted; a task returns one row for each of its nodes.
5. Exact links give the classes.  A text's links are all other texts at the
   threshold, copies included.

No set, link or component passes through the driver; the texts are read twice
(once for the sketches, once for the sets of the nodes that are in a group).

Edge cases: null and empty texts, and texts of white space, are linked to
nothing and are a class each; null ids count as texts of their own but can't be a class id unless
all of a class is null; repeated rows are copies; ties: a class is named by its
least id; empty tables give no rows; other columns are ignored.  A 64-bit hash
names a set (two different sets share one with a probability of 3e-20).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm import textops as X
from postline.llm.graph import components
from postline.session import written

THRESHOLD = 0.8
COORDS = 128
LEVELS = 3
MAX_LEVELS = 9
RECALL = 0.995
BUCKET = 64
MARGIN = 0.15
ANCHORS = 2                  # members, besides the least, that all members of a large bucket are compared with, about
FAMILY = 0.75                # share of a large bucket that must be one family
JUMPS = 2                    # times that the pointers from anchor to anchor are doubled
BLOCK = 512                  # nodes of a block, about
BLOCK_ITEMS = 300_000        # shingles of a block, about
SEED = 10
MAX_IDS = 500_000            # node ids that may be broadcast to find their texts

_rng = np.random.RandomState(SEED)
#: Fixed random numbers of the embedding and of the choice of coordinates.
PERMUTE = _rng.randint(1, 2 ** 31, COORDS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
SHIFT = _rng.randint(0, 2 ** 31, COORDS).astype(np.uint32)
CHOICE = _rng.randint(1, 2 ** 62, COORDS).astype(np.uint64)


def runs_needed(threshold: float = THRESHOLD, levels: int = MAX_LEVELS, recall: float = RECALL) -> int:
    """Runs until a pair exactly at the threshold is found with the target
    recall at the deepest level, over the spread of its agreeing minimum hashes."""
    agree = np.arange(COORDS + 1)
    weight = np.array([math.comb(COORDS, m) * threshold ** m * (1 - threshold) ** (COORDS - m) for m in range(COORDS + 1)])
    stay = np.ones(COORDS + 1)
    for _ in range(levels):
        stay = 1 - (1 - stay / (threshold * COORDS)) ** agree
    runs = 1
    while weight @ (1 - (1 - stay) ** runs) < recall:
        runs += 1
    return runs


def distinct_shingles(batch: pa.RecordBatch, hasher: X.Hasher, text_at: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle, text) pairs, by text, then shingle."""
    data, offsets = X.text_bytes(batch.column(text_at))
    starts, ends, first = X.word_spans(data, offsets, X.WORD)
    h, who = hasher.shingles(hasher.words(data, starts, ends), first)
    order = np.argsort(h)
    h, who = h[order], who[order]
    order = np.argsort(who.astype(np.uint16) if batch.num_rows < 1 << 16 else who, kind="stable")
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return h[new], who[new]


def set_key(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    return X.mix(np.add.reduceat(X.mix(h ^ np.uint64(0x5BD1E995A5A5A5A5)), begin) + size.astype(np.uint64))


def sketches(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, t (text name), node (hash of the set; null without words), size, tokens (minimum hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = X.Hasher(SEED)
        for batch in X.slices(batches, "text"):
            h, who = distinct_shingles(batch, hasher, 1)
            begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(h) else np.zeros(0, np.int64)
            rows, size = who[begin], np.diff(np.append(begin, len(h)))
            tokens = np.zeros((batch.num_rows, COORDS), np.uint32)
            nodes, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32)
            if len(h):
                x = (h >> np.uint64(32)).astype(np.uint32)
                for t in range(COORDS):
                    tokens[rows, t] = np.minimum.reduceat(x * PERMUTE[t] + SHIFT[t], begin)
                nodes[rows], sizes[rows] = set_key(h, begin, size), size
            empty = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes.view(np.int64), mask=empty), pa.array(sizes),
                 X.binary_rows(tokens.ravel(), np.arange(batch.num_rows + 1, dtype=np.int64) * COORDS)], ["doc_id", "t", "node", "size", "tokens"])
    return docs.select("doc_id", "text", "t").mapInArrow(run, f"doc_id {kind}, t long, node long, size int, tokens binary")


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDS)


def split(paths: np.ndarray, at: np.ndarray, tokens: np.ndarray, levels: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Follow paths (of rows ``at`` of ``tokens``) down some levels."""
    chosen = np.uint64(int(2 ** 64 / (threshold * COORDS)))
    for _ in range(levels):
        parts = []
        for i in range(0, len(paths), 4096):
            p, rows = paths[i:i + 4096], at[i:i + 4096]
            r, c = np.nonzero(X.mix(p[:, None] + CHOICE[None, :]) < chosen)
            parts.append((X.mix(p[r] ^ X.mix(tokens[rows[r], c].astype(np.uint64) * np.uint64(2 * COORDS) + c.astype(np.uint64))), rows[r]))
        paths = np.concatenate([p for p, _ in parts]) if parts else paths
        at = np.concatenate([r for _, r in parts]) if parts else at
    return paths, at


def _first_paths(nodes: DataFrame, runs: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = X.mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                n = part.num_rows
                paths, at = split(np.tile(roots, n), np.repeat(np.arange(n), runs), _tokens(part.column(1)), LEVELS, threshold)
                yield pa.RecordBatch.from_arrays([X.int64(paths), part.column(0).take(pa.array(at))], ["path", "node"])
    return nodes.select("node", "tokens").mapInArrow(run, "path long, node long")


def _next_paths(members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                paths, at = split(np.asarray(part.column(0)).view(np.uint64), np.arange(part.num_rows), _tokens(part.column(2)), LEVELS, threshold)
                yield pa.RecordBatch.from_arrays([X.int64(paths), part.column(1).take(pa.array(at))], ["path", "node"])
    return members.join(nodes.select("node", "tokens"), "node").select("path", "node", "tokens").mapInArrow(run, "path long, node long")


def _shared(paths: DataFrame) -> DataFrame:
    """Members of the paths that two nodes or more took, with their number n."""
    paths = paths.distinct()
    many = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    return written(paths.join(many, "path"), "jaccard_buckets")


def _forest(n: int, pairs: np.ndarray) -> list[int]:
    """The least member of each member's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first ``keys`` columns (rows come sorted by them)."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield rows
                now, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield rows


def _likely(buckets: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Candidate links (a, b) of small buckets: a spanning forest of the pairs whose agreement comes near the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = (threshold - MARGIN) * COORDS
        a, b = [], []
        for rows in _groups(batches, 1):
            tokens = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).reshape(len(rows), COORDS)
            i, j = np.triu_indices(len(rows), 1)
            near = (tokens[i] == tokens[j]).sum(1) >= least
            for k, root in enumerate(_forest(len(rows), np.stack([i[near], j[near]], 1))):
                if root != k:
                    a.append(rows[k][1])
                    b.append(rows[root][1])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    lists = buckets.groupBy("path").agg(F.sort_array(F.collect_list("node")).alias("m")).select("m").distinct()  # BUCKET items at most
    members = lists.select(F.xxhash64("m").alias("bucket"), F.explode("m").alias("node"))
    return (members.join(nodes.select("node", "tokens"), "node").select("bucket", "node", "tokens")
            .repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a long, b long"))


def _star(large: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of large buckets' members to some of them, the anchors, where the sketches come near the threshold.
    Anchors are the least node and the members whose hash is below ``ANCHORS`` parts of the bucket's size,
    about that many; the buckets of one family have mostly the same, so the pairs are
    linear in the members."""
    share = (F.xxhash64("node").cast("double") / 2.0 ** 64 + 0.5) * F.col("n")
    least = large.groupBy("path").agg(F.min("node").alias("b"))
    anchors = least.unionByName(large.where(share < ANCHORS).select("path", F.col("node").alias("b")))
    pairs = large.select("path", F.col("node").alias("a")).join(anchors, "path").where("a != b")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tokens = nodes.select("node", "tokens")
    pairs = (pairs.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("a_tokens")), "a")
             .join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("b_tokens")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                near = (_tokens(part.column(2)) == _tokens(part.column(3))).sum(1) >= (threshold - MARGIN) * COORDS
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(near))

    return written(pairs.select("a", "b", "a_tokens", "b_tokens").mapInArrow(run, "a long, b long"), "jaccard_star")


def _by_family(large: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What links make of large buckets: links (a, b) that settle those of which ``FAMILY`` belong to one
    family, and the members of the others.  An anchor points to the least anchor that it
    is linked to or shares a node with; a node's family is where the pointers lead from its least anchor in up to 2 ** ``JUMPS``
    steps, so it is part of one component.  A jump makes one row an anchor, not one a link.  In a settled bucket
    the rest is linked to the family as it is: step 4 compares all of a component, so no link is lost."""
    near = written(links.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("b")), "jaccard_near")  # a node's anchors
    heads = near.select(F.explode("b").alias("a")).distinct()
    linked = near.join(heads, "a").select("a", F.col("b")[0].alias("b"))
    steps = near.select(F.explode("b").alias("a"), F.col("b")[0].alias("b")).unionByName(linked)  # (b, b) too: all anchors stand in it
    both = written(steps.unionByName(steps.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard_heads")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
    for _ in range(JUMPS):
        labels = labels.join(labels.select(F.col("a").alias("label"), F.col("label").alias("next")), "label").select("a", F.col("next").alias("label"))
    first = near.select(F.col("a").alias("node"), F.col("b")[0].alias("a")).join(heads.select(F.col("a").alias("node")), "node", "left_anti")
    labels = first.join(labels, "a").select("node", "label").unionByName(labels.withColumnRenamed("a", "node"))
    named = written(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "jaccard_named")
    sizes = named.groupBy("path", "label").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    main = sizes.where(F.col("m") >= FAMILY * F.col("n")).select("path", F.col("label").alias("family"))
    judged = written(named.join(main, "path", "left"), "jaccard_families")
    rest = judged.where("label != family").select(F.col("node").alias("a"), F.col("family").alias("b"))
    return rest, judged.where("family is null").select("path", "node", "n")


def candidates(nodes: DataFrame, threshold: float = THRESHOLD, runs: int | None = None) -> DataFrame:
    """Candidate links (a, b) among nodes (node, tokens)."""
    runs = runs_needed(threshold) if runs is None else runs
    shared = _shared(_first_paths(nodes, runs, threshold))
    links = _likely(shared.where(F.col("n") <= BUCKET), nodes, threshold)
    stars = None
    for level in range(2 * LEVELS, MAX_LEVELS + 1, LEVELS):
        large = shared.where(F.col("n") > BUCKET)
        if large.isEmpty():
            return links
        star = _star(large, nodes, threshold)
        stars = star if stars is None else stars.unionByName(star)
        rest, large = _by_family(large, stars)
        links = links.unionByName(star).unionByName(rest)
        if large.isEmpty():
            return links
        shared = _shared(_next_paths(large, nodes, threshold))
        links = links.unionByName(_likely(shared.where(F.col("n") <= BUCKET), nodes, threshold))
    large = shared.where(F.col("n") > BUCKET)
    deep = large.join(large.groupBy("path").agg(F.min("node").alias("b")), "path").select(F.col("node").alias("a"), "b")
    return links.unionByName(deep.where("a != b").distinct())


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as a matrix."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = count[item] > 1
    owner, item = owner[both], item[both]
    _, item = np.unique(item, return_inverse=True)
    out = np.zeros((n, n))
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    for at in range(0, int(item[-1]) + 1 if len(item) else 0, 4096):
        a, b = np.searchsorted(item, (at, at + 4096))
        has = np.zeros((n, 4096), np.float32)
        has[owner[a:b], item[a:b] - at] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _compare(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact links in blocks: node, links (texts linked to it by this pair of blocks), root (least node it reaches here)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches, 3):
            crossed = rows[0][1] != rows[0][2]
            side = np.array([r[3] for r in rows])
            copies = np.array([r[5] for r in rows], np.int64)
            found = [np.frombuffer(r[6], np.uint64) for r in rows]
            size = np.array([len(s) for s in found])
            inter = intersections(found)
            linked = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
            np.fill_diagonal(linked, False)
            if crossed:
                linked &= side[:, None] != side[None, :]
            links = linked @ copies
            roots = _forest(len(rows), np.argwhere(np.triu(linked)))
            out += [(r[4], int(n), rows[k][4]) for r, n, k in zip(rows, links, roots) if n]
            if len(out) > 50_000:
                yield _three(out)
                out = []
        yield _three(out)

    def _three(out):
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["node", "links", "root"])

    return sets.mapInArrow(run, "node long, links long, root long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of wanted nodes: rows of ``wanted`` (id, t, node, ...) with the set, from the text of that id and name."""
    names = [c for c in wanted.columns if c not in ("id", "t")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = X.Hasher(SEED)
        at = names.index("node")
        for batch in X.slices(batches, "text"):
            h, who = distinct_shingles(batch, hasher, len(names))
            bounds = np.searchsorted(who, np.arange(batch.num_rows + 1))
            full = np.flatnonzero(np.diff(bounds))
            keys = np.zeros(batch.num_rows, np.uint64)
            keys[full] = set_key(h, bounds[:-1][full], np.diff(bounds)[full])
            mine = pa.array(keys.view(np.int64) == np.asarray(batch.column(at)))  # names are hashes
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], X.binary_rows(h, bounds)], [*names, "members"])
            yield out.filter(mine)

    ids = F.broadcast(wanted) if wanted.count() <= MAX_IDS else wanted.hint("shuffle_hash")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema if f.name in names)
    return (docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]) & (docs["t"] == ids["t"])).select(*names, "text")
            .mapInArrow(run, f"{shape}, members binary"))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, runs: int | None = None) -> DataFrame:
    """One row per text: doc_id, t (text name), node, one (the class's least
    row by id, null last, and text name; null without words) and n_links."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), X.text_name(F.col(text_col)).alias("t"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    all_rows = written(sketches(docs, kind), "jaccard_sketches")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "t"))
    nodes = written(all_rows.where("node is not null").groupBy("node").agg(
        one.alias("one"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("tokens").alias("tokens")), "jaccard_nodes")
    groups = written(components(candidates(nodes, threshold, runs), "jaccard_candidates"), "jaccard_groups")
    sizes = (groups.join(nodes.select("node", "size"), "node").groupBy("label")
             .agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_ITEMS)).cast("int").alias("blocks")))
    wanted = (groups.join(sizes, "label").join(nodes.select("node", "one.id", "one.t", "copies"), "node")
              .select("id", "t", "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("side"), "node", "copies"))
    sets = _sets(docs, written(wanted, "jaccard_wanted")).dropDuplicates(["node"])
    blocks = (sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("label", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "node", "copies", "members")
              .repartition("label", "p", "q").sortWithinPartitions("label", "p", "q", "node"))
    compared = written(_compare(blocks, threshold), "jaccard_links")
    classes = components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")), "jaccard_classes")
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    named = (nodes.select("node", "one", "copies").join(links, "node", "left").join(classes, "node", "left")
             .select("node", "one", F.coalesce("label", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = named.groupBy("class").agg(F.min("one").alias("one"))
    known = written(named.drop("one").join(least, "class").select("node", "one", "n_links"), "jaccard_named")
    rows = all_rows.select("doc_id", "t", "node")
    none = rows.where("node is null").withColumns({"one": F.lit(None).cast(known.schema["one"].dataType), "n_links": F.lit(0).cast("long")})
    return rows.where("node is not null").join(known, "node").select("doc_id", "t", "node", "one", "n_links").unionByName(none)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, runs: int | None = None) -> DataFrame:
    """One row per text: doc_id, class_id (least id of the texts that links
    connect it with) and n_links."""
    return (_classes(docs, id_col, text_col, threshold, runs)
            .select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("one.id")).alias("class_id"), "n_links"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents (all their columns) with one row of each class: the least
    by id (null last), text name and the other columns (as JSON).  Ids may be null or repeat."""
    t = X.fresh(docs, "_text_name")
    named = docs.withColumn(t, X.text_name(F.col(text_col)))
    classes = written(_classes(docs, id_col, text_col, **options).where("node is not null")
                      .select("doc_id", "t", (F.col("doc_id").eqNullSafe(F.col("one.id")) & (F.col("t") == F.col("one.t"))).alias("least")), "jaccard_result")
    kept = X.drop_ids(named, classes.where("not least").select("doc_id", "t"), [id_col, t])
    repeated = classes.where("least").groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "t")
    repeated = written(repeated, "jaccard_repeated")
    if repeated.isEmpty():
        return kept.drop(t)
    same = [kept[id_col].eqNullSafe(repeated["doc_id"]), kept[t] == repeated["t"]]
    others = [f"`{c}`" for c in docs.columns if c != text_col]
    one = (kept.join(repeated.hint("shuffle_hash"), same, "left_semi").groupBy(id_col, t)
           .agg(F.min_by(F.struct(*[f"`{c}`" for c in docs.columns]), F.to_json(F.struct(*others))).alias("_row")).select("_row.*"))
    return X.drop_ids(kept, repeated, [id_col, t]).drop(t).unionByName(one)
