"""Messages: read (S4), parse (S5), provider lookup (P18) and the default
keyword classifier (X2's built-in).

RFC822 parsing needs the standard-library ``email`` package, so S5 runs
per partition in ``mapInArrow``; everything around it is native.
"""

from __future__ import annotations

import email
import re
from email.header import decode_header
from email.message import Message

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postline import rules

PARSED_SCHEMA = "seq bigint, sender string, subject string, body string, error string"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """S4 (batch): raw message files (seq, content) in inbox order."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    return number_messages(raw.select("path", F.col("modificationTime").alias("received_at"), "content"))


def read_messages_stream(spark: SparkSession, path: str) -> DataFrame:
    """S4 (streaming): each file is delivered once (path, received_at,
    content); the checkpoint of the query remembers what was consumed, like the
    UNSEEN flag does.  Micro-batches are numbered by ``number_messages``."""
    return (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
            .option("pathGlobFilter", "*.eml").load(path)
            .select("path", F.col("modificationTime").alias("received_at"), "content"))


def number_messages(raw: DataFrame, batch_id: int = 0) -> DataFrame:
    """(seq, content): ``seq`` is the file's position by modification time, then
    path, after those of earlier micro-batches."""
    from postline.operators.reports import global_positions
    order = global_positions(raw.select("path", "received_at").withColumn("_all", F.lit(1)), ["_all"], [F.col("received_at"), F.col("path")], out="_n")
    seq = F.lit(batch_id).cast("bigint") * F.lit(1 << 32) + F.col("_n")
    return raw.select("path", "content").join(order.select("path", "_n"), "path").select(seq.alias("seq"), "content")


def render_rfc822(messages: DataFrame) -> DataFrame:
    """Messages (seq, sender, subject, body) as RFC822 bytes."""
    text = F.concat(F.lit("From: "), F.col("sender"), F.lit("\r\nSubject: "), F.col("subject"),
                    F.lit("\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=\"utf-8\"\r\n\r\n"), F.col("body"))
    return messages.select("seq", F.encode(text, "UTF-8").alias("content"))


def _as_text(part) -> str:
    """One part's decoded payload as text: the part's charset (UTF-8 when it
    names none), undecodable bytes dropped; '' when there is no payload or
    the charset is unknown."""
    try:
        return part.get_payload(decode=True).decode(part.get_content_charset() or "utf-8", errors="ignore")
    except Exception:
        return ""


def _body(msg) -> str:
    """The text of a message: every text/plain part of a multipart message
    joined in document order; for a single-part message its payload,
    whatever its content type."""
    if not msg.is_multipart():
        return _as_text(msg)
    return "".join(_as_text(p) for p in msg.walk() if p.get_content_type() == "text/plain")


def _subject(msg) -> str:
    """Only the first fragment of the Subject header, decoded with its own
    charset (UTF-8 when unnamed).  A message without a Subject is an error:
    the item is reported in ``error`` and skipped downstream."""
    header = msg.get("Subject")
    if header is None:
        raise ValueError("no Subject header")
    fragments = decode_header(header)
    if not fragments:
        return ""
    first = fragments[0]
    if isinstance(first[0], bytes):
        return first[0].decode((first[1] if len(first) > 1 else None) or "utf-8", errors="ignore")
    return first[0]


# a well-formed head: named headers, their folded lines, an empty line
_HEAD = re.compile(rb"(?:[!-9;-~]+:[\t -~\x80-\xff]*\r?\n(?:[\t ][\t -~\x80-\xff]*\r?\n)*)+(?=(\r?\n))")


def _single_part(content: bytes) -> Message | None:
    """A message with a well-formed head and one part, as
    ``email.message_from_bytes`` reads it but without its line-by-line parser,
    which takes most of the time; None for any other message."""
    head = _HEAD.match(content)
    if head is None:
        return None
    msg = Message()
    folded: list[str] = []
    for line in head.group().decode("ascii", "surrogateescape").splitlines(keepends=True):
        if folded and line[0] not in " \t":
            msg.set_raw(*msg.policy.header_source_parse(folded))
            folded = []
        folded.append(line)
    msg.set_raw(*msg.policy.header_source_parse(folded))
    if msg.get_content_maintype() in ("multipart", "message"):
        return None
    msg.set_payload(content[head.end(1):].decode("ascii", "surrogateescape"))
    return msg


def _parse_one(content: bytes):
    msg = _single_part(content)
    if msg is None:
        msg = email.message_from_bytes(content)
    return msg.get("From"), _subject(msg), _body(msg)


def _parse_batches(batches):
    for batch in batches:
        out = {"sender": [], "subject": [], "body": [], "error": []}
        for content in batch.column("content").to_pylist():
            try:
                s, j, b = _parse_one(bytes(content))
                out["sender"].append(None if s is None else str(s))
                out["subject"].append(j)
                out["body"].append(b)
                out["error"].append(None)
            except Exception as e:                       # the item is skipped downstream
                out["sender"].append(None)
                out["subject"].append(None)
                out["body"].append(None)
                out["error"].append(f"{type(e).__name__}: {e}")
        yield pa.RecordBatch.from_arrays([batch.column("seq").cast(pa.int64()), *[pa.array(v, pa.string()) for v in out.values()]],
                                         names=["seq", *out])


MESSAGES_PER_TASK = 20_000


def dealt(raw: DataFrame) -> DataFrame:
    """Raw messages dealt to tasks by their number.  A message is small in a
    file and takes far longer to parse than to read, so tasks cut by bytes
    would be few and long."""
    return raw.repartition(max(1, -(-raw.count() // MESSAGES_PER_TASK)))


def parse_messages(raw: DataFrame) -> DataFrame:
    """(seq, content bytes) -> sender, subject (first encoded fragment),
    body (all text/plain parts); failures go to ``error``."""
    return raw.select("seq", "content").mapInArrow(_parse_batches, PARSED_SCHEMA)


def write_parsed(parsed: DataFrame, path: str, batch_id: int) -> None:
    """Sink of S4/S5: a folder for each micro-batch, replaced when the batch is replayed."""
    parsed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


# exact-domain mode (Q23): provider domains
PROVIDER_DOMAINS = {
    "gmail": ["gmail.com", "googlemail.com"],
    "outlook": ["outlook.com", "hotmail.com", "live.com", "office365.com"],
    "yahoo": ["yahoo.com"],
    "icloud": ["icloud.com", "me.com", "mac.com"],
}


def mail_provider(address: Column, exact_domain: bool = False) -> Column:
    """Provider by substring of the domain; unknown -> gmail.  The
    substring test sends 'acme.com' to icloud ('me.com'); ``exact_domain``
    compares whole domains instead (Q23)."""
    dom = F.when(F.contains(address, F.lit("@")), F.lower(F.substring_index(address, "@", -1))).otherwise(F.lit(""))
    if exact_domain:
        name = None
        for prov, doms in PROVIDER_DOMAINS.items():
            hit = dom.isin(doms)
            name = F.when(hit, F.lit(prov)) if name is None else name.when(hit, F.lit(prov))
        name = name.otherwise(F.lit("gmail"))
        host = F.coalesce(*[F.when(name == n, F.lit(h)) for n, h, _ in rules.MAIL_PROVIDERS])
        return F.struct(name.alias("provider"), host.alias("host"), F.lit(993).alias("port"))
    marks = [(prov, F.contains(dom, F.lit(part))) for prov, parts in rules.PROVIDER_MARKS for part in parts]
    name = F.coalesce(*[F.when(hit, F.lit(prov)) for prov, hit in marks], F.lit(rules.MAIL_PROVIDERS[0][0]))
    host = F.coalesce(*[F.when(name == n, F.lit(h)) for n, h, _ in rules.MAIL_PROVIDERS])
    return F.struct(name.alias("provider"), host.alias("host"), F.lit(993).alias("port"))


# Default classifier keywords (this module's own rules; a user-supplied
# classifier replaces them).  Sub-stages are tested in this order.
DECLINE_WORDS = ["unfortunately", "not to move forward", "regret", "other candidates"]
SUB_STAGE_WORDS = [
    ("Offer", ["offer letter", "pleased to offer"]),
    ("Home Assignment", ["home assignment", "take-home"]),
    ("Tech Interview", ["technical interview", "tech interview"]),
    ("Manager Interview", ["manager interview", "hiring manager"]),
    ("HR Screen", ["hr screen", "phone screen", "hr interview"]),
]


def keyword_classification(subject: Column, body: Column) -> Column:
    """Default classifier: keyword rules -> classification struct."""
    t = F.lower(F.concat_ws(" ", subject, body))

    def has(words):
        out = None
        for w in words:
            c = F.contains(t, F.lit(w))
            out = c if out is None else out | c
        return out

    declined = has(DECLINE_WORDS)
    sub = None
    for stage, words in SUB_STAGE_WORDS:
        sub = F.when(has(words), F.lit(stage)) if sub is None else sub.when(has(words), F.lit(stage))
    relevant = declined | sub.isNotNull()
    return F.struct(relevant.alias("is_relevant_update"),
                    F.when(declined, F.lit("Declined")).when(sub.isNotNull(), F.lit("In Process")).alias("new_stage"),
                    F.when(~declined, sub).alias("new_sub_stage"),
                    F.when(declined, F.lit("rejection wording")).when(sub.isNotNull(), F.concat(F.lit("mentions "), F.lower(sub)))
                    .otherwise(F.lit("no next step")).alias("reasoning"))
