"""Chat formatting by schema fingerprints.

A record is a JSON object in any of several layouts (messages, prompt and
completion, instruction and output, ...).  Its fingerprint is a hash of its
nested field paths (list items share the path ``[]``).  Each layout is a
declarative mapping: the paths it has, those that may be missing, and where roles and
texts come from; the fingerprints of all its variants are tabled, so a
record is matched by one look-up and converted to canonical turns (role,
text).  A record with an unknown fingerprint gives no turns and is returned with its
fingerprint, so that a mapping can be written for it.

Template: a turn is ``<turn ROLE>\\n`` TEXT ``\\n</turn>\\n``.  Inside texts and
roles a backslash is doubled and the strings ``<turn`` and ``</turn`` (in
roles also ``>``) get a backslash before them, so no text can open or close a
turn, and removing one backslash before each character gives the text back.  The
loss mask covers the escaped texts of assistant turns.

Formatted turns are rows, never gathered: reading back sorts a conversation's turns
inside a partition and streams over them with one hash state a conversation, so a
long conversation needs no memory of its own.

Edge cases: a null text is empty, a null role is the empty role; rows of one
conversation with equal turn numbers are ordered by a hash of the record (null turns
first); null ids form one conversation; repeated rows are turns of their own;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layouts: name, needed paths, paths that may be missing, turns.  A turn is
#: (role or path of the role, path of the text, whether an empty or missing
#: text is left out); a list path gives a turn for each item.
LAYOUTS = [
    ("turn", ["role", "text"], [], [("$role", "text", False)]),
    ("messages", ["messages", "messages[]", "messages[].role", "messages[].content"], ["id", "source"],
     [("$messages[].role", "messages[].content", False)]),
    ("conversations", ["conversations", "conversations[]", "conversations[].from", "conversations[].value"], ["id", "source", "system"],
     [("system", "system", True), ("$conversations[].from", "conversations[].value", False)]),
    ("instruction", ["instruction", "output"], ["input", "system", "id"],
     [("system", "system", True), ("user", "instruction+input", False), ("assistant", "output", False)]),
    ("prompt", ["prompt", "completion"], ["system", "id"],
     [("system", "system", True), ("user", "prompt", False), ("assistant", "completion", False)]),
    ("response", ["prompt", "response"], ["system", "id"],
     [("system", "system", True), ("user", "prompt", False), ("assistant", "response", False)]),
    ("question", ["question", "answer"], ["context", "id"],
     [("system", "context", True), ("user", "question", False), ("assistant", "answer", False)]),
    ("nested", ["data", "data.prompt", "data.response"], ["data.system", "id"],
     [("system", "data.system", True), ("user", "data.prompt", False), ("assistant", "data.response", False)]),
]
#: Names that other layouts use for the same roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

SCHEMA_TURNS = "conv_id {}, turn {}, tie long, pos int, role string, text string, layout string, fingerprint string"
SCHEMA_SEGMENTS = "conv_id {}, turn {}, tie long, pos int, segment string, loss_start int, loss_end int"


def paths(value, at: str = "") -> set[str]:
    """All nested field paths of a parsed record."""
    out: set[str] = set()
    todo = [(value, at)]
    while todo:
        x, here = todo.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                name = f"{here}.{k}" if here else k
                out.add(name)
                todo.append((v, name))
        elif isinstance(x, list) and x:
            out.add(here + "[]")
            todo += [(v, here + "[]") for v in x]
    return out


def fingerprint(field_paths) -> str:
    return hashlib.blake2b("\n".join(sorted(field_paths)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def mappings(layouts=None) -> dict[str, tuple[str, list]]:
    """Fingerprint -> (layout, turns), for every variant of every layout."""
    out = {}
    for name, needed, optional, turns in LAYOUTS if layouts is None else layouts:
        for n in range(len(optional) + 1):
            for extra in itertools.combinations(optional, n):
                out[fingerprint([*needed, *extra])] = (name, turns)
    return out


def _get(record, path: str):
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, turns: list) -> list[tuple[str, str]]:
    out = []
    for role, path, skip in turns:
        if "[]" in path:
            top, _, leaf = path.partition("[].")
            who = role.partition("[].")[2]
            out += [(ROLES.get(r := _text(_get(x, who)), r), _text(_get(x, leaf))) for x in _get(record, top) or ()]
            continue
        text = "\n".join(t for p in path.split("+") if (t := _text(_get(record, p)))) if "+" in path else _text(_get(record, path))
        if text or not skip:
            role = _text(_get(record, role[1:])) if role[0] == "$" else role
            out.append((ROLES.get(role, role), text))
    return out


def canonical(records: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", record_col: str = "record", layouts=None) -> DataFrame:
    """Turns of JSON records: conv_id, turn (of the record), tie, pos (in the
    record), role, text, layout, fingerprint.  A record of no known layout (or
    no JSON object) gives one row with null role, text and layout."""
    table = mappings(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[frozenset, str] = {}
        for batch in batches:
            at, rest = [], []
            for i, raw in enumerate(batch.column(3).to_pylist()):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                shape = frozenset(paths(record)) if isinstance(record, dict) else frozenset()
                mark = known.get(shape) or known.setdefault(shape, fingerprint(shape))
                layout, turns = table.get(mark, (None, None))
                made = turns_of(record, turns) if layout else [(None, None)]
                at += [i] * len(made)
                rest += [(p, r, t, layout, mark) for p, (r, t) in enumerate(made)]
            pos, role, text, layout, mark = zip(*rest) if rest else ((),) * 5
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(index) for c in batch.columns[:3]), pa.array(pos, pa.int32()), pa.array(role, pa.string()),
                                              pa.array(text, pa.string()), pa.array(layout, pa.string()), pa.array(mark, pa.string())],
                                             ["conv_id", "turn", "tie", "pos", "role", "text", "layout", "fingerprint"])

    kinds = [records.schema[c].dataType.simpleString() for c in (id_col, turn_col)]
    return records.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(record_col).alias("tie"),
                          F.col(record_col).alias("record")).mapInArrow(run, SCHEMA_TURNS.format(*kinds))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn", "\\<turn").replace("</turn", "\\</turn")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text stands in it."""
    head = "<turn " + escape(role).replace(">", "\\>") + ">\n"
    body = escape(text)
    return head + body + "\n</turn>\n", len(head), len(head) + len(body)


def read(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = re.fullmatch(r"(?s)<turn ((?:[^\\>]|\\.)*)>\n(.*)\n</turn>\n", formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def format_turns(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Formatted turns with their loss mask (code points inside the segment;
    null where nothing is learned): conv_id, turn, tie, pos, segment, loss_start, loss_end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(*segment(r or "", t or ""), r) for r, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([m[0] for m in made], pa.string()),
                                              pa.array([m[1] if m[3] == trained else None for m in made], pa.int32()),
                                              pa.array([m[2] if m[3] == trained else None for m in made], pa.int32())],
                                             ["conv_id", "turn", "tie", "pos", "segment", "loss_start", "loss_end"])

    kinds = [turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    return turns.select("conv_id", "turn", "tie", "pos", "role", "text").mapInArrow(run, SCHEMA_SEGMENTS.format(*kinds))


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of the formatted conversations, parsed again: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        done: list[tuple] = []
        now, state = None, None

        def flush(kind):
            cols = list(zip(*done)) or [()] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names)

        def close():
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for conv, formatted, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5, 6))):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(formatted)
                if a is not None:
                    learned = unescape(formatted[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
            if len(done) > 10_000:
                yield flush(kind)
        close()
        if kind is not None:
            yield flush(kind)

    kind = segments.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "tie", "pos"]
    return segments.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
