"""Join operators.

J1's "URL known OR (title, company) known" is two chained anti joins (an
OR condition would plan as a nested-loop join).  J3's substring match runs an
automaton of the tracked names over the messages; beyond a bound on the names it is
an exact equi-join on character grams followed by a verification, never a
cross join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline import rules
from postline.functions import urls
from postline.operators import seen
from postline.operators.dedup import norm_key
from postline.operators.filters import py_strip
from postline.operators.seen import KeyIndex

#: Names and parts of names that are sent to all tasks: their number and characters.
MAX_NEEDLES = 50_000
MAX_NEEDLE_CHARS = 1_000_000
#: Characters of a gram that names and texts are joined on beyond that.
GRAM = 3


def _has_title_company(title: Column, company: Column) -> Column:
    return (F.coalesce(title, F.lit("")) != "") & (F.coalesce(company, F.lit("")) != "")


def _known_keys(batch: DataFrame, jobs: DataFrame, empty_url_fallback: bool = False):
    """The stored URLs and (title, company) keys that occur in the batch.

    The stored table is only semi-joined to the batch's keys, so the big
    side is never deduplicated or shuffled as a whole: once AQE has measured
    the batch's key set it can broadcast it and stream the stored table
    past it.  Both results are bounded by the batch size."""
    b_url = batch.select("_nu").distinct()
    if empty_url_fallback:
        # an empty URL identifies nothing: only (title, company) decides (Q6)
        b_url = b_url.where(F.col("_nu") != "")
    b_tc = batch.where(_has_title_company(F.col("title"), F.col("company"))).select("_t", "_c").distinct()
    seen_url = jobs.select(F.col("url").alias("_nu")).join(b_url, "_nu", "left_semi").distinct()
    seen_tc = (jobs.select(norm_key(F.col("title")).alias("_t"), norm_key(F.col("company")).alias("_c"))
               .join(b_tc, ["_t", "_c"], "left_semi").distinct())
    return seen_url, seen_tc


def _keyed(batch: DataFrame) -> DataFrame:
    return (batch.withColumn("_nu", urls.normalize_url(F.col("url")))
            .withColumn("_t", norm_key(F.col("title"))).withColumn("_c", norm_key(F.col("company"))))


def _known_by_index(batch: DataFrame, index: KeyIndex, empty_url_fallback: bool):
    """The batch with its keys (_ku, _kt), and the stored ones among them."""
    url = F.when(F.col("_nu") != "", F.col("_nu")) if empty_url_fallback else F.col("_nu")
    b = batch.withColumns({"_ku": seen.url_key(url), "_kt": seen.title_key(F.col("title"), F.col("company"))})
    return b, index.known(b.select(F.explode(F.array("_ku", "_kt")).alias("key")))


def drop_seen(batch: DataFrame, jobs: DataFrame | None, empty_url_fallback: bool = False, index: KeyIndex | None = None) -> DataFrame:
    """Postings whose canonical URL is not stored and whose (title,
    company), compared lower/trim and only when both are non-empty, is not
    stored either.  Two equi anti joins (an OR condition would plan as a
    nested-loop join).  By default an empty URL matches a stored empty URL
    (as a UNIQUE column does); ``empty_url_fallback`` ignores empty URLs.
    With an ``index`` of the stored keys, ``jobs`` is not read."""
    b = _keyed(batch)
    if index is not None:
        b, known = _known_by_index(b, index, empty_url_fallback)
        for key in ("_ku", "_kt"):
            b = b.join(known.withColumnRenamed("key", key), key, "left_anti")
        return b.drop("_nu", "_t", "_c", "_ku", "_kt")
    seen_url, seen_tc = _known_keys(b, jobs, empty_url_fallback)
    b = b.join(seen_url, "_nu", "left_anti")
    cond = (b["_t"] == seen_tc["_t"]) & (b["_c"] == seen_tc["_c"]) & _has_title_company(b["title"], b["company"])
    return b.join(seen_tc, cond, "left_anti").drop("_nu", "_t", "_c")


def is_processed(batch: DataFrame, jobs: DataFrame | None, empty_url_fallback: bool = False, index: KeyIndex | None = None) -> DataFrame:
    """J1 as a flag: ``seen_by`` is 'url', 'title_company' or NULL."""
    b = _keyed(batch)
    if index is not None:
        b, known = _known_by_index(b, index, empty_url_fallback)
        out = (b.join(known.select(F.col("key").alias("_ku"), F.lit(True).alias("_hit_u")), "_ku", "left")
               .join(known.select(F.col("key").alias("_kt"), F.lit(True).alias("_hit_t")), "_kt", "left"))
    else:
        seen_url, seen_tc = _known_keys(b, jobs, empty_url_fallback)
        out = (b.join(seen_url.withColumn("_hit_u", F.lit(True)), "_nu", "left")
               .join(seen_tc.withColumn("_hit_t", F.lit(True)), ["_t", "_c"], "left"))
    flag = (F.when(F.col("_hit_u"), F.lit("url"))
            .when(F.col("_hit_t") & _has_title_company(F.col("title"), F.col("company")), F.lit("title_company")))
    return out.withColumn("seen_by", flag).drop("_nu", "_t", "_c", "_hit_u", "_hit_t", "_ku", "_kt")


# ---------------------------------------------------------------------------
# Mail -> company -> jobs
# ---------------------------------------------------------------------------
def active_order(active: DataFrame) -> DataFrame:
    """To Apply jobs (newest first) then In Process jobs (newest first),
    ties by id: the order the matcher walks companies in."""
    block = F.when(F.col("stage") == "To Apply", F.lit(0)).otherwise(F.lit(1))
    return active.withColumn("active_ord", F.struct(block.alias("b"), (-F.unix_micros(F.col("date_found").cast("timestamp"))).alias("d"),
                                                    F.col("id").alias("id")))


def company_key(company: Column) -> Column:
    """Tracked-company key: lowered, surrounding whitespace stripped the way
    Python's ``str.strip`` does (the mail matcher keys companies in Python,
    unlike the SQL TRIM of the dedup key)."""
    return F.lower(py_strip(company))


def _as_text(c: Column) -> Column:
    """A header as the matcher reads it: ``str(value).lower()``, so a missing
    header reads as 'none'."""
    return F.lower(F.coalesce(c, F.lit("None")))


def company_index(active: DataFrame) -> DataFrame:
    """One row per tracked company key with its position in the active
    order and its job count.  Blank keys are dropped (a blank name would
    match every message and then fail the truthiness test)."""
    a = active_order(active).withColumn("company_key", company_key(F.col("company")))
    a = a.where(F.col("company_key") != "")
    return a.groupBy("company_key").agg(F.min("active_ord").alias("company_ord"),
                                        F.count(F.lit(1)).cast("bigint").alias("n_jobs"))


def word_parts(company: Column) -> Column:
    """the parts of a name split on single spaces, longer than 2 characters."""
    return F.filter(F.split(company, " "), lambda p: F.length(p) > 2)


def _needles(companies: DataFrame) -> DataFrame:
    """What the matcher looks for: whole keys (tier 1) and their parts (tier 2)."""
    c = companies.select("company_key", "company_ord")
    return (c.select("company_key", "company_ord", F.lit(1).alias("tier"), F.col("company_key").alias("needle"))
            .unionByName(c.select("company_key", "company_ord", F.lit(2).alias("tier"), F.explode(word_parts(F.col("company_key"))).alias("needle")))
            .where(F.length("needle") > 0))


def match_company(messages: DataFrame, companies: DataFrame, max_needles: int = MAX_NEEDLES, max_chars: int = MAX_NEEDLE_CHARS) -> DataFrame:
    """Per message the company to update.  Tier 1: the company key is a
    substring of the lowered sender or subject; tier 2 (only without a tier-1
    hit): a space-separated part of the key longer than 2 characters is a
    substring of the sender.  Within a tier the company first in active order
    wins.  Returns (seq, company_key, tier).

    The names and parts of the tracked companies are fetched, at most one more than the
    bound.  Within it (number and characters) they are sent to all tasks as an Aho-Corasick
    automaton, and the messages are matched where they are, without a shuffle.  Beyond it the
    distinct texts meet the names in an equi-join on character grams.  Both give the same rows."""
    needles = _needles(companies)
    found = needles.limit(max_needles + 1).collect()
    if len(found) <= max_needles and sum(len(r["needle"]) for r in found) <= max_chars:
        return _match_by_automaton(messages, found)
    return _match_by_grams(messages, needles)


_AUTOMATA: dict[int, object] = {}       # of this worker process: the automaton last used


def _automaton(number: int, needles: dict):
    if number not in _AUTOMATA:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for needle, ranks in needles.items():
            automaton.add_word(needle, ranks)
        automaton.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[number] = automaton
    return _AUTOMATA[number]


def _match_by_automaton(messages: DataFrame, found: list) -> DataFrame:
    # the order of a struct: field by field, nulls first
    found = sorted(found, key=lambda r: (r["tier"], [(v is not None, v) for v in r["company_ord"]], r["company_key"]))
    none = len(found)
    ranks: dict[str, list[int]] = {}
    for i, r in enumerate(found):
        mine = ranks.setdefault(r["needle"], [none, none])
        mine[r["tier"] - 1] = min(mine[r["tier"] - 1], i)
    shared = messages.sparkSession.sparkContext.broadcast(
        ({n: (whole, min(whole, part)) for n, (whole, part) in ranks.items()}, [r["company_key"] for r in found], [r["tier"] for r in found]))
    number = uuid.uuid4().int

    def best(texts: pa.Array, which: int) -> np.ndarray:
        """The least rank found in each text, looked up once for equal texts of a batch."""
        coded = texts.dictionary_encode()
        automaton = _automaton(number, shared.value[0])
        least = [min((ranks[which] for _, ranks in automaton.iter(t)), default=none) for t in coded.dictionary.to_pylist()]
        return np.array(least, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(texts) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, keys, tiers = shared.value
        for batch in batches:
            rank = np.minimum(best(batch.column(1), 1), best(batch.column(2), 0))
            hit = np.flatnonzero(rank < none)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), pa.array([keys[i] for i in rank[hit]], pa.string()),
                                              pa.array([tiers[i] for i in rank[hit]], pa.int32())], ["seq", "company_key", "tier"])

    texts = messages.select("seq", _as_text(F.col("sender")).alias("sender"), _as_text(F.col("subject")).alias("subject"))
    kind = texts.schema["seq"].dataType.simpleString()
    if not found:
        return texts.limit(0).select("seq", F.lit(None).cast("string").alias("company_key"), F.lit(None).cast("int").alias("tier"))
    return texts.mapInArrow(run, f"seq {kind}, company_key string, tier int")


def _match_by_grams(messages: DataFrame, needles: DataFrame) -> DataFrame:
    """The match for any number of names.  Each distinct text is split into code points once.
    Names of three characters or more are looked for at the positions whose first
    three characters are theirs: a position carries a slice as long as the longest
    name, so what a shuffle carries is linear in the text.  Shorter names are among the
    text's distinct short grams."""
    heads = messages.select("seq", _as_text(F.col("sender")).alias("_s"), _as_text(F.col("subject")).alias("_j"))
    both = F.array(F.struct(F.lit(True).alias("is_sender"), F.col("_s").alias("text")), F.struct(F.lit(False).alias("is_sender"), F.col("_j").alias("text")))
    texts = heads.select(F.explode(both).alias("_m")).select("_m.*").distinct()
    texts = texts.select(F.xxhash64("is_sender", "text").alias("_h"), "*")
    long, short = needles.where(F.length("needle") >= GRAM), needles.where(F.length("needle") < GRAM)
    longest = long.agg(F.coalesce(F.max(F.length("needle")), F.lit(0))).scalar()
    chars = texts.select("_h", "is_sender", F.regexp_extract_all(F.col("text"), F.lit("(?s)."), F.lit(0)).alias("_chars"))
    at = (chars.select("_h", "is_sender", "_chars", F.posexplode("_chars").alias("_p", "_c"))
          .select("_h", "is_sender", F.array_join(F.slice("_chars", F.col("_p") + 1, longest), "").alias("_slice"))
          .withColumn("_gram", F.substring("_slice", 1, GRAM)))
    long = long.withColumn("_gram", F.substring("needle", 1, GRAM))
    at = at.join(long.select("_gram").distinct(), "_gram", "left_semi")
    hits = at.join(long, "_gram").where(F.col("_slice").startswith(F.col("needle")))
    grams = F.array_distinct(F.flatten(F.transform("_chars", lambda c, i: F.array(c, F.array_join(F.slice("_chars", i + 1, 2), "")))))
    few = chars.select("_h", "is_sender", F.explode(grams).alias("needle")).join(short, "needle")
    columns = ["_h", "is_sender", "tier", "company_ord", "company_key"]
    hits = hits.select(*columns).unionByName(few.select(*columns)).where((F.col("tier") == 1) | F.col("is_sender"))
    best = hits.groupBy("_h").agg(F.min(F.struct("tier", "company_ord", "company_key")).alias("_b"))
    known = texts.join(best, "_h").select("is_sender", "text", "_b")
    sender = known.where("is_sender").select(F.col("text").alias("_s"), F.col("_b").alias("_bs"))
    subject = known.where("not is_sender").select(F.col("text").alias("_j"), F.col("_b").alias("_bj"))
    return (heads.join(sender, "_s", "left").join(subject, "_j", "left").select("seq", F.least("_bs", "_bj").alias("_b")).where("_b is not null")
            .select("seq", F.col("_b.company_key").alias("company_key"), F.col("_b.tier").alias("tier")))


def fan_out_updates(matched: DataFrame, active: DataFrame) -> DataFrame:
    """Every active job of the matched company gets the message's update."""
    jobs = active.select("id", company_key(F.col("company")).alias("company_key"))
    return matched.join(jobs, "company_key")


# ---------------------------------------------------------------------------
# Crawl planning
# ---------------------------------------------------------------------------
def plan_crawl(sites: DataFrame, queries: list[str] | None = None) -> DataFrame:
    """Every (site, query) task.  The query list is a fixed parameter,
    so each site row is expanded in place (no join)."""
    qs = rules.DEFAULT_QUERIES if queries is None else queries
    arr = F.array(*[F.struct(F.lit(i + 1).alias("query_ord"), F.lit(q).alias("query")) for i, q in enumerate(qs)])
    return sites.select("*", F.explode(arr).alias("_q")).select("*", "_q.query", "_q.query_ord").drop("_q")


def is_fresh(fetched_at: Column, now: Column, ttl_seconds: int = rules.CACHE_TTL_SECONDS) -> Column:
    """a cached result is valid while ``now < fetched_at + ttl`` (strict)."""
    return now < fetched_at + F.make_dt_interval(secs=F.lit(ttl_seconds))


def skip_fresh(tasks: DataFrame, results: DataFrame, now: Column, ttl_seconds: int = rules.CACHE_TTL_SECONDS):
    """Tasks without an unexpired cached result, and the reusable results."""
    fresh = results.where(is_fresh(F.col("fetched_at"), now, ttl_seconds))
    keyed_tasks = tasks.withColumn("task_key", urls.task_key(F.col("site"), F.col("query")))
    keys = fresh.select(urls.task_key(F.col("site"), F.col("query")).alias("task_key")).distinct()
    to_fetch = keyed_tasks.join(keys, "task_key", "left_anti")
    reused = fresh.withColumn("task_key", urls.task_key(F.col("site"), F.col("query"))) \
        .join(keyed_tasks.select("task_key"), "task_key", "left_semi")
    return to_fetch, reused


def skip_open_circuits(tasks: DataFrame, breaker: DataFrame) -> DataFrame:
    """Drop tasks of sites whose breaker is open."""
    return tasks.join(breaker.where(F.col("is_open")).select("site"), "site", "left_anti")


def union_sources(*frames: DataFrame) -> DataFrame:
    """All postings of all tasks, duplicates kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_outcomes(rejected: DataFrame, scored: DataFrame) -> DataFrame:
    """Pre-filter rejections and scored postings as one outcome set."""
    return rejected.unionByName(scored, allowMissingColumns=True)
