"""Rule classification.

Each rule is a Column expression over the posting's own columns, so a
whole cascade is one projection: no join against the rule tables, no
Python.  "First pattern in list order" is ``filter`` over the pattern
array, element 1: one compact expression per rule, which keeps the
generated code of a full cascade far below the JVM method-size limit
(a ``coalesce`` of ~100 ``when`` branches exceeds it and drops the whole
stage out of whole-stage codegen).
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline import rules
from postline.functions import evaluation as ev


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends, NULL as ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def _patterns(patterns: list[str]) -> Column:
    return F.array(*[F.lit(p) for p in patterns])


def _first_hit(texts: list[Column], patterns: list[str], test) -> Column:
    """First pattern (list order) for which ``test(texts, pattern)`` holds.

    A fold over the pattern array whose accumulator carries the texts: each
    text expression is evaluated once per row, never once per pattern, even
    when Catalyst inlines an upstream expression (a pushed-down filter does;
    expressions inside a lambda are not shared by subexpression
    elimination)."""
    init = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(texts)], F.lit(None).cast("string").alias("hit"))

    def step(acc, p):
        ts = [acc[f"t{i}"] for i in range(len(texts))]
        return F.struct(*[x.alias(f"t{i}") for i, x in enumerate(ts)],
                        F.coalesce(acc["hit"], F.when(test(ts, p), p)).alias("hit"))
    return F.aggregate(_patterns(patterns), init, step)["hit"]


def _any_of(patterns: list[str]) -> str:
    """One alternation of literal patterns (Java syntax)."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in patterns)


def all_hits(texts: list[Column], patterns: list[str], test) -> Column:
    """Every pattern (list order) for which ``test(texts, pattern)`` holds,
    with the texts carried in the fold's accumulator as in ``_first_hit``."""
    init = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(texts)], F.array().cast("array<string>").alias("hits"))

    def step(acc, p):
        ts = [acc[f"t{i}"] for i in range(len(texts))]
        return F.struct(*[x.alias(f"t{i}") for i, x in enumerate(ts)],
                        F.when(test(ts, p), F.array_append(acc["hits"], p)).otherwise(acc["hits"]).alias("hits"))
    return F.aggregate(_patterns(patterns), init, step)["hits"]


def first_contained(text_lower: Column, patterns: list[str]) -> Column:
    """First pattern (list order) that is a substring of ``text_lower``."""
    # most texts hold none: one compiled alternation tells, and the ordered
    # (interpreted) fold runs only on texts that hold one
    return F.when(text_lower.rlike(_any_of(patterns)), _first_hit([text_lower], patterns, lambda ts, p: F.contains(ts[0], p)))


_NON_WORD = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    """Lowered text with every run of non-letters/digits as one space, padded."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _NON_WORD, " "), F.lit(" "))


def _word_form(pattern: str) -> str:
    return " " + re.sub(r"[^\w]+|_", " ", pattern.lower()).strip() + " "


def _first_word_match(texts: list[Column], patterns: list[str]) -> Column:
    """Word-boundary variant (Q5): the first pattern whose words occur as
    whole words in one of ``texts``; returns the pattern as listed."""
    forms = {_word_form(p): p for p in reversed(patterns)}          # first listed pattern per word form
    hit = _first_hit([_words(t) for t in texts], [_word_form(p) for p in patterns],
                     lambda ts, w: functools.reduce(lambda a, b: a | b, [F.contains(x, w) for x in ts]))
    return F.element_at(F.create_map(*[F.lit(x) for kv in forms.items() for x in kv]), hit)


def location_rejected(location: Column, word_boundary: bool = False) -> Column:
    """P5: the first rejected location pattern found, or NULL.  Patterns are
    substrings ('usa' inside 'jerusalem', Q5); ``word_boundary`` matches
    whole words only."""
    if word_boundary:
        return _first_word_match([location], rules.REJECTED_LOCATIONS)
    return first_contained(F.lower(location), rules.REJECTED_LOCATIONS)


def overseas_company(company: Column, title: Column, word_boundary: bool = False) -> Column:
    """The first overseas pattern found in company or title, or NULL."""
    if word_boundary:
        return _first_word_match([company, title], rules.OVERSEAS_COMPANY_PATTERNS)
    c, t = F.lower(company), F.lower(title)
    some = _any_of(rules.OVERSEAS_COMPANY_PATTERNS)
    hit = _first_hit([c, t], rules.OVERSEAS_COMPANY_PATTERNS, lambda ts, p: F.contains(ts[0], p) | F.contains(ts[1], p))
    return F.when(c.rlike(some) | t.rlike(some), hit)


def foreign_university(company: Column) -> Column:
    """Company mentions university/college and no listed local one."""
    c = F.lower(company)
    marked = F.contains(c, F.lit("university")) | F.contains(c, F.lit("college"))
    return marked & ~c.rlike(_any_of(rules.LOCAL_UNIVERSITIES))


def is_overseas(title: Column, company: Column, location: Column) -> Column:
    """P5 or P6 or P7, without stripping and without a reason."""
    return (location_rejected(location).isNotNull() | overseas_company(company, title).isNotNull()
            | foreign_university(company))


def senior_title(title: Column, escape: bool = False) -> Column:
    """The first seniority keyword matched as ``\\b<kw>\\b`` (unescaped,
    so 'sr.' matches 'srx' but not 'Sr. Developer'; ``escape=True`` matches
    keywords literally, Q7), unless the title contains 'student' or 'intern'."""
    t = F.lower(title)
    exempt = F.contains(t, F.lit("student")) | F.contains(t, F.lit("intern"))
    pats = [(kw, re.escape(kw) if escape else kw) for kw in rules.SENIORITY_KEYWORDS]
    # a literal keyword ending in a non-word character ('sr.') has no \b after it
    hit = F.coalesce(*[F.when(t.rlike(r"(?U)\b" + p + (r"\b" if not escape or kw[-1].isalnum() else "")), F.lit(kw))
                       for kw, p in pats])
    some = t.rlike("(?U)" + "|".join(r"\b(?:" + p + ")" for _, p in pats))
    return F.when(some & ~exempt, hit)


EXPERIENCE_REGEX = "(?U)" + "|".join(f"(?:{p})" for p in rules.EXPERIENCE_PATTERNS)


def requires_experience(title: Column, description: Column) -> Column:
    """P10: any experience regex in the lowered title or description."""
    return F.lower(title).rlike(EXPERIENCE_REGEX) | F.lower(description).rlike(EXPERIENCE_REGEX)


def pre_filter_reason(title: Column, company: Column, location: Column, description: Column,
                      word_boundary: bool = False) -> Column:
    """Ordered cascade P5 -> P6 -> P7 -> P9 -> P10; the first reason, or NULL."""
    t, c, loc, d = py_strip(title), py_strip(company), py_strip(location), py_strip(description)
    p5 = location_rejected(loc, word_boundary)
    p6 = overseas_company(c, t, word_boundary)
    p9 = senior_title(t)
    # concat is NULL when its pattern is NULL, so each reason needs no guard
    return F.coalesce(
        F.concat(F.lit("Location '"), loc, F.lit("' matches rejected pattern '"), p5, F.lit("'")),
        F.concat(F.lit("Company/Title matches rejected overseas pattern '"), p6, F.lit("'")),
        F.when(foreign_university(c), F.concat(F.lit("Non-Israeli university: '"), c, F.lit("'"))),
        F.concat(F.lit("Title contains seniority keyword '"), p9, F.lit("'")),
        F.when(requires_experience(t, d), F.lit(rules.EXPERIENCE_REASON)),
    )


def pre_filter(df: DataFrame, title="title", company="company", location="location",
               description="description", word_boundary: bool = False) -> DataFrame:
    """P11 as a DataFrame operator: adds ``reject_reason`` and ``is_rejected``."""
    reason = pre_filter_reason(F.col(title), F.col(company), F.col(location), F.col(description), word_boundary)
    return df.withColumn("reject_reason", reason).withColumn("is_rejected", F.col("reject_reason").isNotNull())


def geo_location(location: Column, ai_summary: Column) -> Column:
    """Location the geo filter tests: scraped unless empty / 'Not specified',
    else the evaluation's location when the summary parses as an object."""
    scraped = F.when(location.isNotNull() & (location != "") & (location != rules.NOT_SPECIFIED), location)
    ai_loc = F.when(ev._is_object(ai_summary), ev.json_field(ai_summary, "location", rules.NOT_SPECIFIED))
    return F.coalesce(scraped, ai_loc, F.lit(rules.NOT_SPECIFIED))


def apply_geo_filter(jobs: DataFrame) -> DataFrame:
    """P11 over To Apply rows (description = raw evaluation JSON text);
    rejected rows move to Irrelevant.  Adds ``geo_reason``."""
    reason = pre_filter_reason(F.col("title"), F.col("company"), geo_location(F.col("location"), F.col("ai_summary")),
                               F.coalesce(F.col("ai_summary"), F.lit("")))
    out = jobs.withColumn("geo_reason", F.when(F.col("stage") == "To Apply", reason))
    return out.withColumn("stage", F.when(F.col("geo_reason").isNotNull(), F.lit("Irrelevant")).otherwise(F.col("stage")))


def demote_low_scores(jobs: DataFrame, threshold: int = rules.RELEVANCE_THRESHOLD) -> DataFrame:
    """To Apply rows whose evaluation is neither relevant nor scored
    >= threshold move to Irrelevant; unusable summaries are left alone.
    Adds ``demoted``."""
    score = ev.parse_score_or_null(F.col("ai_summary"))
    relevant = ev.is_relevant(F.col("ai_summary"))
    demote = (F.col("stage") == "To Apply") & score.isNotNull() & ~(relevant | (score >= threshold))
    return (jobs.withColumn("demoted", F.coalesce(demote, F.lit(False)))
            .withColumn("stage", F.when(F.col("demoted"), F.lit("Irrelevant")).otherwise(F.col("stage"))))


def active_jobs(jobs: DataFrame, stages=None) -> DataFrame:
    """P20: jobs whose stage is tracked by the mail matcher."""
    return jobs.where(F.col("stage").isin(rules.ACTIVE_STAGES if stages is None else stages))


def relevant_updates(classified: DataFrame, col: str = "classification") -> DataFrame:
    """Keep messages classified as a real update."""
    return classified.where(F.coalesce(F.col(col)["is_relevant_update"], F.lit(False)))


def valid_postings(postings: DataFrame) -> DataFrame:
    """Drop postings without a title."""
    return postings.where(F.col("title").isNotNull() & (F.col("title") != ""))
