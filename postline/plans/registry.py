"""Query registry: one Spark query per operator ID plus, where the
semantics are expressible in SQL, the DuckDB oracle statement.

Each Spark query reads the driver tables at ``sf_dir`` (whole tables, no
subsets) through the adapters in ``postline.sources.tables``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postline import rules
from postline.functions import evaluation as ev
from postline.functions import urls
from postline.operators import dedup, filters, joins, reports, seen, state
from postline.plans import duck as d
from postline.plans import cycle, scoring
from postline.sources import html
from postline.sources import tables as tb
from postline.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


def sday(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


J = d.with_(d.JOBS)
DESC = d.with_(d.DESCRIBED)
SCORED_JOBS = d.with_(d.JOBS, f"sj AS (SELECT *, {d.score('ai_summary')} AS score FROM jobs)")
RANK = "CASE coalesce(stage, 'Irrelevant') WHEN 'Applied' THEN 3 WHEN 'To Apply' THEN 2 ELSE 1 END"


# ---------------------------------------------------------------------------
# 2.1 scans, sources, sinks
# ---------------------------------------------------------------------------
@query("S1", J + "SELECT id, title, company, stage FROM jobs WHERE stage IN ('To Apply', 'Irrelevant')")
def s1(spark, sf):
    return tb.scan_jobs(tb.jobs(spark, sf), ["To Apply", "Irrelevant"]).select("id", "title", "company", "stage")


CARDS_SQL = d.with_(d.CARDS)


@query("S2", CARDS_SQL + "SELECT page_id, position, title, url FROM cards")
def s2(spark, sf):
    from postline.session import remember_scratch, scratch_path
    import uuid
    path = remember_scratch(scratch_path(spark, f"postings_{uuid.uuid4().hex}"))
    cards = html.extract_list_cards(tb.read(spark, sf, "pages"))
    cards.select("site", "query", "position", "title", "company", "url", "location",
                 F.lit(None).cast("string").alias("description")).write.parquet(path)
    back = tb.scan_postings(spark, path)
    return back.select(F.col("query").cast("bigint").alias("page_id"), "position", "title", "url")


@query("S2_json", CARDS_SQL + "SELECT page_id, position, title, url, row_number() OVER (PARTITION BY page_id ORDER BY position) AS arrival FROM cards")
def s2_json(spark, sf):
    """Postings in JSON files get the order of arrival from the files: each page's cards stand in one file, in order."""
    data, _ = streams.stream_scratch(spark, "postings")
    cards = html.extract_list_cards(tb.read(spark, sf, "pages")).select("site", "query", "position", "title", "company", "url", "location")
    cards.repartitionByRange("query").sortWithinPartitions("query", "position").write.json(data)
    back = tb.scan_postings(spark, data, "json")
    place = F.row_number().over(W.partitionBy("query").orderBy("seq"))        # the cards of one page
    return back.select(F.col("query").cast("bigint").alias("page_id"), "position", "title", "url", place.alias("arrival"))


def _clean_cards(spark, sf):
    return html.clean_postings(html.extract_list_cards(tb.read(spark, sf, "pages")))


CLEAN_SQL = (d.with_(d.CARDS, "titled AS (SELECT * FROM cards WHERE title IS NOT NULL AND title <> '')",
                     "linked AS (SELECT *, CASE WHEN url IS NOT NULL AND url <> '' AND NOT starts_with(url, 'http') "
                     "THEN base_url || url ELSE url END AS link FROM titled)"))


@query("S3", CLEAN_SQL + "SELECT page_id, position, title, company, location, f2 AS url, "
       "upper(substr(site, 1, 1)) || lower(substr(site, 2)) || ' Job: ' || title || ' @ ' || company AS description "
       f"FROM ({d.canonical_url('linked', 'link', 'f2', True)}) x")
def s3(spark, sf):
    return _clean_cards(spark, sf).select("page_id", "position", "title", "company", "location", "url", "description")


# one page a part, in the card layout of one of the six boards: a full card, then
# one without company and location; list items stay open, as pages leave them
BOARD_CARDS = [
    ("linkedin", "<ul><li><div class='base-card'><h3 class='base-search-card__title'>{t}</h3>{c}<a class='base-card__full-link' href='{u}'>o</a>{l}</div>",
     "<h4 class='base-search-card__subtitle'>{c}</h4>", "<span class='job-search-card__location'>{l}</span>"),
    ("indeed", "<div class='job_seen_beacon'><h2 class='jobTitle'><a href='{u}'><span>{t}</span></a></h2>{c}{l}</div>",
     "<span data-testid='company-name'>{c}</span>", "<div data-testid='text-location'>{l}</div>"),
    ("jobmaster", "<div class='JobItem'><div class='CardHeader'><a href='{u}'>{t}</a></div>{c}{l}</div>",
     "<div>{c}</div>", "<span class='jobLocation'>{l}</span>"),
    ("drushim", "<div class='job-item-main'><a class='job-url' href='{u}'>{t}</a>{c}{l}</div>",
     "<p class='company-name'>{c}", "<div class='job-location'>{l}</div>"),
    ("alljobs", "<div class='job-content'><div class='job-content-title'><a href='{u}'>{t}</a></div>{c}{l}</div>",
     "<div class='job-content-company'>{c}</div>", "<div class='job-content-location'>{l}</div>"),
    ("nisha", "<article class='job'><h3><a href='{u}'>{t}</a></h3>{c}{l}</article>",
     "<span class='company'>{c}</span>", "<span class='location'>{l}</span>"),
]


BOARD_PAGES_PER_TASK = 4000


def _board_pages(spark, sf):
    part = tb.read(spark, sf, "part")
    # a part's row is small and its page takes far longer to parse than to read, so a task gets
    # a number of rows, not of bytes; dealt before the pages are laid out
    part = part.select("p_partkey", "p_name", "p_brand", "p_type").repartition(max(1, -(-part.count() // BOARD_PAGES_PER_TASK)))

    def filled(layout: str, **values) -> Column:
        out = F.lit(layout)
        for name, value in values.items():
            out = F.replace(out, F.lit("{" + name + "}"), value)
        return out

    def page(layout, company, location):
        both = [filled(layout, c=filled(company, c=F.col("p_brand")), l=filled(location, l=F.col("p_type")),
                       t=F.concat("p_name", F.lit(" &amp; co")), u=F.concat(F.lit("/jobs/"), "p_partkey")),
                filled(layout, c=F.lit(""), l=F.lit(""), t=F.col("p_name"), u=F.lit("/more"))]
        return F.concat(F.lit("<html><body>" + "<div>" * 3), *both, F.lit("</body></html>"))

    i = F.col("p_partkey") % len(BOARD_CARDS)
    return part.select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("query"),
                       F.coalesce(*[F.when(i == k, F.lit(x[0])) for k, x in enumerate(BOARD_CARDS)]).alias("site"),
                       F.coalesce(*[F.when(i == k, page(*x[1:])) for k, x in enumerate(BOARD_CARDS)]).alias("html"))


_BOARD_OF = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {d.q(x[0])}" for i, x in enumerate(BOARD_CARDS)) + " END AS site"


@query("S3_boards", f"SELECT p_partkey AS page_id, {_BOARD_OF}, 1 AS position, p_name || ' & co' AS title, p_brand AS company, "
       "'/jobs/' || p_partkey AS url, p_type AS location, CAST(NULL AS VARCHAR) AS error FROM part UNION ALL "
       f"SELECT p_partkey, {_BOARD_OF}, 2, p_name, 'Unknown', '/more', 'Israel', NULL FROM part")
def s3_boards(spark, sf):
    """S3 over the six board profiles."""
    return html.extract_cards(_board_pages(spark, sf)).select("page_id", "site", "position", "title", "company", "url", "location", "error")


@query("S5", d.with_(d.MESSAGES) + "SELECT seq, sender, subject, body FROM messages")
def s5(spark, sf):
    raw = tb.messages(spark, sf)
    from postline.sources.mail import dealt, parse_messages, render_rfc822
    return parse_messages(dealt(render_rfc822(raw))).where(F.col("error").isNull()).select("seq", "sender", "subject", "body")


RULE_VALUES = ("rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({d.q(n)}, {i + 1}, {d.q(p)})" for n, vals in rules.RULE_SETS for i, p in enumerate(vals)) + ") AS t(rule_set, ordinal, pattern))")
S6_HITS = ("hits AS (SELECT 'rejected_location' AS rule_set, unnest(list_filter([" + ", ".join(d.q(x) for x in rules.REJECTED_LOCATIONS)
           + "], lambda p: contains(lower(location), p))) AS pattern FROM located UNION ALL SELECT 'overseas_company', "
           "unnest(list_filter([" + ", ".join(d.q(x) for x in rules.OVERSEAS_COMPANY_PATTERNS)
           + "], lambda p: contains(lower(company), p) OR contains(lower(title), p))) FROM described UNION ALL SELECT 'tracker', "
           "unnest(list_filter([" + ", ".join(d.q(x) for x in rules.TRACKER_PATTERNS) + "], lambda p: contains(lower(url), p))) "
           "FROM pages)")


@query("S6", d.with_(d.LOCATED, d.DESCRIBED, RULE_VALUES, S6_HITS) + "SELECT r.rule_set, r.ordinal, r.pattern, "
       "CAST(count(h.pattern) AS BIGINT) AS hits FROM rules r LEFT JOIN hits h ON r.rule_set = h.rule_set AND r.pattern = h.pattern "
       "GROUP BY ALL")
def s6(spark, sf):
    """The ordered rule tables with how often each pattern fires on the
    data (every contained pattern, not only the first)."""
    def fired(df, name, pats, texts, test):
        hits = filters.all_hits(texts, pats, test)
        return df.select(F.lit(name).alias("rule_set"), F.explode(hits).alias("pattern"))
    loc = fired(tb.located(spark, sf), "rejected_location", rules.REJECTED_LOCATIONS,
                [F.lower(F.col("location"))], lambda ts, p: F.contains(ts[0], p))
    com = fired(tb.described(spark, sf), "overseas_company", rules.OVERSEAS_COMPANY_PATTERNS,
                [F.lower(F.col("company")), F.lower(F.col("title"))], lambda ts, p: F.contains(ts[0], p) | F.contains(ts[1], p))
    trk = fired(tb.read(spark, sf, "pages"), "tracker", rules.TRACKER_PATTERNS, [F.lower(F.col("url"))],
                lambda ts, p: F.contains(ts[0], p))
    counts = loc.unionByName(com).unionByName(trk).groupBy("rule_set", "pattern").agg(F.count(F.lit(1)).alias("hits"))
    # the rule table has a fixed, small size (the lists in rules.py)
    return (F.broadcast(rules.rules_frame(spark)).join(counts, ["rule_set", "pattern"], "left")
            .select("rule_set", "ordinal", "pattern", F.coalesce(F.col("hits"), F.lit(0)).cast("bigint").alias("hits")))


STORE_BATCH = d.with_(d.JOBS, d.STORE, d.BATCH)


@query("S7", STORE_BATCH + "SELECT n.url AS url, n.title AS title, "
       "CAST((SELECT max(id) FROM store) + row_number() OVER (ORDER BY n.id) AS BIGINT) AS id FROM ("
       "SELECT b.* FROM (SELECT *, row_number() OVER (PARTITION BY f1 ORDER BY id) AS rn FROM ("
       + d.canonical_url("batch", "url", "f1", False, "id, title") + ") z) b "
       "WHERE rn = 1 AND f1 NOT IN (SELECT url FROM store)) n0 JOIN (SELECT id, f1 AS url, title FROM ("
       + d.canonical_url("batch", "url", "f1", False, "id, title") + ") y) n ON n.id = n0.id")
def s7(spark, sf):
    store, batch = tb.store_and_batch(spark, sf)
    b = batch.withColumnRenamed("id", "seq")
    ins = state.append_new(store, b, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return ins.select("url", "title", "id")


def _store_index(spark, sf):
    """The stored half as an index of its keys, and the batch."""
    store, batch = tb.store_and_batch(spark, sf)
    data, _ = streams.stream_scratch(spark, "keys")
    return seen.write_index(store, f"{data}/index"), batch


@query("S7_index", ORACLE["S7"])
def s7_index(spark, sf):
    index, batch = _store_index(spark, sf)
    ins = state.append_new(None, batch.withColumnRenamed("id", "seq"), F.lit("2024-06-01 00:00:00").cast("timestamp"), index)
    return ins.select("url", "title", "id")


UPDATES_SQL = d.with_(d.JOBS, d.STAGE_LOG,
                      "latest AS (SELECT id, max(seq) AS seq, arg_max({'s': new_stage, 'ss': new_sub_stage}, seq) AS u "
                      "FROM stage_log GROUP BY id)")


@query("S8", UPDATES_SQL + "SELECT j.id, CASE WHEN l.id IS NOT NULL THEN l.u.s ELSE j.stage END AS stage, "
       "CASE WHEN l.id IS NOT NULL THEN l.u.ss ELSE j.sub_stage END AS sub_stage "
       "FROM jobs j LEFT JOIN latest l ON j.id = l.id")
def s8(spark, sf):
    updates = dedup.latest_update_per_job(tb.stage_log(spark, sf))
    return state.apply_updates(tb.jobs(spark, sf), updates).select("id", "stage", "sub_stage")


A1_SQL = SCORED_JOBS + (f"SELECT id, stage FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(title)), "
                        f"lower(trim(company)) ORDER BY {RANK} DESC, score DESC, id) AS rn FROM sj) WHERE rn = 1")


@query("S9", A1_SQL.replace("SELECT id, stage FROM (", "SELECT id, title FROM jobs WHERE id IN (SELECT id FROM (", 1) + ")")
def s9(spark, sf):
    j = tb.jobs(spark, sf)
    return dedup.keep_rows(j, dedup.dedup_postings(j)).select("id", "title")


@query("S11", J + "SELECT id, CASE WHEN ai_summary ILIKE 'Irrelevant:%' OR ai_summary ILIKE '%\"is_relevant\": false%' "
       "THEN 'Irrelevant' ELSE 'To Apply' END AS stage, CAST(NULL AS STRING) AS sub_stage, 'Not specified' AS location FROM jobs")
def s11(spark, sf):
    old = tb.jobs(spark, sf).drop("stage", "sub_stage", "location")
    return state.evolve_schema(old).select("id", "stage", "sub_stage", "location")


# ---------------------------------------------------------------------------
# 2.2 projections, filters, predicates
# ---------------------------------------------------------------------------
SITES_SQL = ("sites AS (SELECT * FROM (VALUES " + ", ".join(
    f"({d.q(s)}, {d.q(b)}, {d.q(p)}, {d.q(x)})" for s, b, p, x in rules.SITES) + ") AS t(site, base_url, pre, suf))")
QUERIES_SQL = ("qs AS (SELECT * FROM (VALUES " + ", ".join(
    f"({d.q(x)}, {i + 1})" for i, x in enumerate(rules.DEFAULT_QUERIES)) + ") AS t(query, query_ord))")


P1_TASKS = ("tasks AS (SELECT p_partkey AS id, p_name AS query, CASE p_partkey % 6 " + " ".join(
    f"WHEN {i} THEN {d.q(x[0])}" for i, x in enumerate(rules.SITES)) + " END AS site, CASE p_partkey % 6 " + " ".join(
    f"WHEN {i} THEN {d.q(x[2])}" for i, x in enumerate(rules.SITES)) + " END AS pre, CASE p_partkey % 6 " + " ".join(
    f"WHEN {i} THEN {d.q(x[3])}" for i, x in enumerate(rules.SITES)) + " END AS suf FROM part)")


@query("P1", d.with_(P1_TASKS) + "SELECT id, site, pre || " + d.quote("query") + " || suf AS search_url FROM tasks")
def p1(spark, sf):
    """One crawl task per part: the part name is the search text, the board
    is picked by key, so the task list grows with the data."""
    tasks = tb.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("query"))
    prof = rules.site_profile(F.col("id") % len(rules.SITES))
    return tasks.select("id", prof["site"].alias("site"),
                        urls.build_search_url(prof["search_prefix"], F.col("query"), prof["search_suffix"]).alias("search_url"))


@query("P2", CLEAN_SQL + "SELECT page_id, position, link FROM linked")
def p2(spark, sf):
    c = filters.valid_postings(html.extract_list_cards(tb.read(spark, sf, "pages")))
    return c.select("page_id", "position", urls.absolutise_link(F.col("url"), F.col("base_url")).alias("link"))


@query("P3", CARDS_SQL + "SELECT page_id, position, title FROM cards WHERE title IS NOT NULL AND title <> ''")
def p3(spark, sf):
    return filters.valid_postings(html.extract_list_cards(tb.read(spark, sf, "pages"))).select("page_id", "position", "title")


@query("P4", CLEAN_SQL + "SELECT page_id, position, upper(substr(site, 1, 1)) || lower(substr(site, 2)) || ' Job: ' "
       "|| title || ' @ ' || company AS description FROM linked")
def p4(spark, sf):
    return _clean_cards(spark, sf).select("page_id", "position", "description")


@query("P5", d.with_(d.LOCATED) + f"SELECT id, {d.p5('location')} AS pattern FROM located")
def p5(spark, sf):
    return tb.located(spark, sf).select("id", filters.location_rejected(F.col("location")).alias("pattern"))


@query("P6", DESC + f"SELECT id, {d.p6('company', 'title')} AS pattern FROM described")
def p6(spark, sf):
    return tb.described(spark, sf).select("id", filters.overseas_company(F.col("company"), F.col("title")).alias("pattern"))


@query("P7", DESC + f"SELECT id, {d.p7('company')} AS foreign_university FROM described")
def p7(spark, sf):
    return tb.described(spark, sf).select("id", filters.foreign_university(F.col("company")).alias("foreign_university"))


@query("P8", DESC + f"SELECT id, ({d.p5('location')} IS NOT NULL OR {d.p6('company', 'title')} IS NOT NULL "
       f"OR {d.p7('company')}) AS overseas FROM described")
def p8(spark, sf):
    return tb.described(spark, sf).select(
        "id", filters.is_overseas(F.col("title"), F.col("company"), F.col("location")).alias("overseas"))


@query("P9", DESC + f"SELECT id, {d.p9('title')} AS keyword FROM described")
def p9(spark, sf):
    return tb.described(spark, sf).select("id", filters.senior_title(F.col("title")).alias("keyword"))


@query("P10", DESC + f"SELECT id, {d.p10('title', 'description')} AS requires_experience FROM described")
def p10(spark, sf):
    return tb.described(spark, sf).select(
        "id", filters.requires_experience(F.col("title"), F.col("description")).alias("requires_experience"))


P11_EXPR = d.p11("title", "company", "location", "description")


@query("P11", DESC + f"SELECT id, reason AS reject_reason, reason IS NOT NULL AS is_rejected FROM "
       f"(SELECT id, {P11_EXPR} AS reason FROM described)")
def p11(spark, sf):
    return filters.pre_filter(tb.described(spark, sf)).select("id", "reject_reason", "is_rejected")


GEO_LOC = (f"coalesce(CASE WHEN location IS NOT NULL AND location <> '' AND location <> 'Not specified' THEN location END, "
           f"CASE WHEN {d.is_obj('ai_summary')} THEN {d.field('ai_summary', 'location', rules.NOT_SPECIFIED)} END, "
           f"'Not specified')")
GEO_REASON = f"CASE WHEN stage = 'To Apply' THEN {d.p11('title', 'company', GEO_LOC, 'coalesce(ai_summary, ' + chr(39) * 2 + ')')} END"


@query("P12", J + f"SELECT id, coalesce(CASE WHEN location <> '' AND location <> 'Not specified' THEN location END, "
       f"CASE WHEN {d.is_obj('ai_summary')} THEN {d.field('ai_summary', 'location', rules.NOT_SPECIFIED)} END, "
       f"'Not specified') AS effective_location FROM jobs")
def p12(spark, sf):
    return tb.jobs(spark, sf).select("id", ev.effective_location(F.col("location"), F.col("ai_summary")).alias("effective_location"))


@query("P13", J + f"SELECT id, CASE WHEN geo_reason IS NOT NULL THEN 'Irrelevant' ELSE stage END AS stage, geo_reason "
       f"FROM (SELECT *, {GEO_REASON} AS geo_reason FROM jobs)")
def p13(spark, sf):
    return filters.apply_geo_filter(tb.jobs(spark, sf)).select("id", "stage", "geo_reason")


DEMOTE = (f"(stage = 'To Apply' AND {d.score_or_null('ai_summary')} IS NOT NULL AND NOT ({d.relevant('ai_summary')} "
          f"OR {d.score_or_null('ai_summary')} >= 70))")


@query("P14", J + f"SELECT id, CASE WHEN demoted THEN 'Irrelevant' ELSE stage END AS stage, demoted FROM "
       f"(SELECT *, coalesce({DEMOTE}, false) AS demoted FROM jobs)")
def p14(spark, sf):
    return filters.demote_low_scores(tb.jobs(spark, sf)).select("id", "stage", "demoted")


@query("P15", J + f"SELECT id, CASE WHEN {d.relevant('ai_summary')} AND {d.score('ai_summary')} >= 70 "
       f"THEN 'To Apply' ELSE 'Irrelevant' END AS routed FROM jobs")
def p15(spark, sf):
    j = tb.jobs(spark, sf)
    return j.select("id", ev.route_by_score(ev.is_relevant(F.col("ai_summary")), ev.parse_score(F.col("ai_summary"))).alias("routed"))


# locations with characters that JSON escapes (quotes, control characters, Hebrew, beyond the BMP)
ODD_TEXT = "CASE WHEN id % 3 = 0 THEN location || ' \"' || chr(9) || chr(1) || chr(127) || '\u05ea\u05dc \U0001F4CD' ELSE location END"


@query("P16", DESC + f"SELECT id, {d.rejected_eval('reason', '(' + ODD_TEXT + ')')} AS ai_summary FROM "
       f"(SELECT id, location, {P11_EXPR} AS reason FROM described) WHERE reason IS NOT NULL")
def p16(spark, sf):
    pf = filters.pre_filter(tb.described(spark, sf)).where(F.col("is_rejected"))
    return pf.select("id", ev.rejected_evaluation(F.col("reject_reason"), F.expr(ODD_TEXT)).alias("ai_summary"))


@query("P17", "SELECT page_id, (CASE page_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'script' "
       "ELSE 'xhr' END) IN (" + ", ".join(d.q(t) for t in rules.BLOCKED_RESOURCE_TYPES) + ") OR ("
       + " OR ".join(f"contains(lower(url), {d.q(p)})" for p in rules.TRACKER_PATTERNS) + ") AS blocked FROM pages")
def p17(spark, sf):
    p = tb.read(spark, sf, "pages").select("page_id", "url")
    rt = F.expr("CASE page_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'script' ELSE 'xhr' END")
    return p.select("page_id", urls.blocked_request(rt, F.col("url")).alias("blocked"))


PROVIDER_SQL = ("CASE WHEN contains(dom, 'gmail.com') THEN 'gmail' WHEN contains(dom, 'outlook') OR contains(dom, 'office365') "
                "OR contains(dom, 'live.') OR contains(dom, 'hotmail.') THEN 'outlook' WHEN contains(dom, 'yahoo') THEN 'yahoo' "
                "WHEN contains(dom, 'icloud.com') OR contains(dom, 'me.com') THEN 'icloud' ELSE 'gmail' END")


@query("P18", d.with_(d.MESSAGES) + f"SELECT seq, {PROVIDER_SQL} AS provider FROM (SELECT seq, CASE WHEN contains(sender, '@') "
       "THEN lower(split_part(sender, '@', -1)) ELSE '' END AS dom FROM messages)")
def p18(spark, sf):
    from postline.sources.mail import mail_provider
    return tb.messages(spark, sf).select("seq", mail_provider(F.col("sender"))["provider"].alias("provider"))


@query("P19", SCORED_JOBS + "SELECT id, CASE WHEN score >= 85 THEN 'high' ELSE 'normal' END AS badge FROM sj")
def p19(spark, sf):
    return tb.jobs(spark, sf).select("id", ev.score_badge(ev.parse_score(F.col("ai_summary"))).alias("badge"))


@query("P20", J + "SELECT id, stage FROM jobs WHERE stage IN ('To Apply', 'In Process')")
def p20(spark, sf):
    return filters.active_jobs(tb.jobs(spark, sf)).select("id", "stage")


RECHECK_DESC = (f"CASE WHEN {d.is_obj('ai_summary')} THEN 'Previous Evaluation Info:' || chr(10) || 'Location: ' || "
                f"{d.field('ai_summary', 'location', rules.NOT_SPECIFIED)} || chr(10) || 'Summary: ' || "
                f"{d.field('ai_summary', 'summary', '')} || chr(10) || 'Qualifications: ' || "
                f"{d.field('ai_summary', 'important_qualifications', '')} ELSE {d.q(rules.RECHECK_DEFAULT_TEXT)} END")


@query("P22", J + f"SELECT id, {RECHECK_DESC} AS description FROM jobs")
def p22(spark, sf):
    return tb.jobs(spark, sf).select("id", ev.recheck_input(F.col("ai_summary")).alias("description"))


def _sql_text(s: str) -> str:
    parts = s.split("\n")
    return " || chr(10) || ".join(d.q(p) for p in parts)


@query("P23", DESC + "SELECT id, " + " || ".join(
    f"{_sql_text(label)} || {col}" for label, col in zip(rules.PROMPT_LABELS, ["title", "company", "location", "description"]))
    + " || " + _sql_text(rules.PROMPT_TAIL) + " AS prompt FROM described")
def p23(spark, sf):
    t = tb.described(spark, sf)
    return t.select("id", ev.prompt_text(F.col("title"), F.col("company"), F.col("location"), F.col("description")).alias("prompt"))


@query("P23_system", "SELECT " + _sql_text(rules.SYSTEM_PROMPT_HEAD) + " || 'Looks for ' || (SELECT count(*) FROM part) || ' roles' || "
       + _sql_text(rules.SYSTEM_PROMPT_PRIORITIES) + " || string_agg('TIER ' || n || ': ' || p_type || ' roles', chr(10) ORDER BY n) || "
       + _sql_text(rules.SYSTEM_PROMPT_TAIL) + " AS prompt FROM (SELECT p_type, row_number() OVER (ORDER BY p_type) AS n FROM part GROUP BY p_type)")
def p23_system(spark, sf):
    """The scorer's instructions from a priorities text (S6): a file of ordered lines with blank ones between."""
    data, _ = streams.stream_scratch(spark, "priorities")
    part = tb.read(spark, sf, "part")
    kinds = part.groupBy("p_type").count().select("p_type", F.row_number().over(W.orderBy("p_type")).alias("n"))   # a few kinds
    line = F.concat(F.lit("TIER "), F.col("n").cast("string"), F.lit(": "), F.col("p_type"), F.lit(" roles\n"))
    kinds.orderBy("n").coalesce(1).select(line.alias("value")).write.text(data)
    profile = part.agg(F.concat(F.lit("Looks for "), F.count("*").cast("string"), F.lit(" roles"))).scalar()
    return rules.system_prompt(rules.priorities_frame(spark, data), profile)


@query("P24", DESC + "SELECT id, CASE WHEN length(description) > 20 THEN substr(description, 1, 20) || chr(10) || "
       "'...(truncated)' ELSE description END AS short_text FROM described")
def p24(spark, sf):
    t = tb.described(spark, sf)
    return t.select("id", ev.truncate_text(F.col("description"), 20, rules.TRUNCATION_SUFFIX).alias("short_text"))


# ---------------------------------------------------------------------------
# 2.8 scalar functions
# ---------------------------------------------------------------------------
@query("F1", "SELECT page_id, f1 AS canonical_url FROM (" + d.canonical_url("pages", "url", "f1", False, "page_id") + ")")
def f1(spark, sf):
    return tb.read(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("canonical_url"))


@query("F2", "SELECT page_id, f2 AS canonical_url FROM (" + d.canonical_url("pages", "url", "f2", True, "page_id") + ")")
def f2(spark, sf):
    return tb.read(spark, sf, "pages").select("page_id", urls.normalize_url_strict(F.col("url")).alias("canonical_url"))


@query("F3", J + "SELECT id, lower(trim(title)) AS norm_title, lower(trim(company)) AS norm_company FROM jobs")
def f3(spark, sf):
    return tb.jobs(spark, sf).select("id", dedup.norm_key(F.col("title")).alias("norm_title"),
                                     dedup.norm_key(F.col("company")).alias("norm_company"))


@query("F4", SCORED_JOBS + "SELECT id, score FROM sj")
def f4(spark, sf):
    return tb.jobs(spark, sf).select("id", ev.parse_score(F.col("ai_summary")).alias("score"))


@query("F5", J + f"SELECT id, {d.score_or_null('ai_summary')} AS score FROM jobs")
def f5(spark, sf):
    return tb.jobs(spark, sf).select("id", ev.parse_score_or_null(F.col("ai_summary")).alias("score"))


@query("F7", J + f"SELECT id, CASE WHEN {d.is_obj('ai_summary')} THEN {d.field('ai_summary', 'key_features', 'N/A')} "
       f"ELSE 'N/A' END AS key_features FROM jobs")
def f7(spark, sf):
    return tb.jobs(spark, sf).select("id", ev.json_field(F.col("ai_summary"), "key_features", "N/A").alias("key_features"))


@query("F11", d.with_(d.ATTEMPTS) + "SELECT DISTINCT site, query, md5(site || ':' || query) AS task_key FROM attempts")
def f11(spark, sf):
    a = tb.attempts(spark, sf)
    return a.select("site", "query").distinct().withColumn("task_key", urls.task_key(F.col("site"), F.col("query")))


F18_TEXT = "lower(concat_ws(' ', title, description))"
F18_BAND = (f"CASE WHEN regexp_matches({F18_TEXT}, '\\b(student|intern|internship|working student)\\b') THEN 95 "
            f"WHEN regexp_matches({F18_TEXT}, '(no experience|0 years|entry[- ]level|graduate)') THEN 85 "
            f"WHEN regexp_matches({F18_TEXT}, '(junior|jr\\b|[0-2]\\+?\\s*(years|yrs))') THEN 70 ELSE 60 END")
F18_SCORE = (f"least({F18_BAND} + CASE WHEN contains(lower(coalesce(description, '')), 'easy apply') THEN 3 ELSE 0 END, "
             f"CASE {F18_BAND} WHEN 95 THEN 100 WHEN 85 THEN 94 WHEN 70 THEN 84 ELSE 69 END)")


@query("F18", DESC + f"SELECT id, CASE WHEN {P11_EXPR} IS NOT NULL THEN 0 ELSE {F18_SCORE} END AS tier_score FROM described")
def f18(spark, sf):
    pf = filters.pre_filter(tb.described(spark, sf))
    return pf.select("id", ev.tier_score(F.col("title"), F.col("description"), F.col("is_rejected"),
                                         F.contains(F.lower(F.coalesce(F.col("description"), F.lit(""))), F.lit("easy apply")))
                     .alias("tier_score"))


@query("X1", DESC + f"SELECT id, {F18_SCORE} >= 70 AS is_relevant, {F18_SCORE} AS match_score FROM described "
       f"WHERE {P11_EXPR} IS NULL")
def x1(spark, sf):
    pf = filters.pre_filter(tb.described(spark, sf)).where(~F.col("is_rejected"))
    s = scoring.score_postings(pf)
    return s.select("id", F.col("evaluation.is_relevant").alias("is_relevant"), F.col("evaluation.match_score").alias("match_score"))


# ---------------------------------------------------------------------------
# 2.4-2.6 aggregations, dedup, rankings
# ---------------------------------------------------------------------------
@query("A1", A1_SQL)
def a1(spark, sf):
    return dedup.dedup_postings(tb.jobs(spark, sf)).select("id", "stage")


@query("A2", SCORED_JOBS + "SELECT id, url, score FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, id) "
       "AS rn FROM (SELECT id, 'https://x.example.com/jobs/' || CAST(id % 500 AS STRING) AS url, score FROM sj)) WHERE rn = 1")
def a2(spark, sf):
    j = tb.jobs(spark, sf).select("id", F.concat(F.lit("https://x.example.com/jobs/"), (F.col("id") % 500).cast("string")).alias("url"),
                                  ev.parse_score(F.col("ai_summary")).alias("score"))
    return dedup.dedup_by_url(j).select("id", "url", "score")


@query("A3", CARDS_SQL + "SELECT page_id, position, title FROM cards WHERE position <= 5")
def a3(spark, sf):
    return dedup.cap_per_task(html.extract_list_cards(tb.read(spark, sf, "pages")), 5).select("page_id", "position", "title")


@query("A4", UPDATES_SQL + "SELECT id, seq, u.s AS new_stage, u.ss AS new_sub_stage FROM latest")
def a4(spark, sf):
    return dedup.latest_update_per_job(tb.stage_log(spark, sf))


TRAIL_SQL = d.with_(d.ATTEMPTS, "lastok AS (SELECT site, max(CASE WHEN success THEN ts END) AS lts, "
                    "arg_max(CASE WHEN success THEN id END, CASE WHEN success THEN ts END) AS lid FROM attempts GROUP BY site)",
                    "trail AS (SELECT a.site, CAST(count(*) FILTER (WHERE NOT success AND (lts IS NULL OR a.ts > lts OR "
                    "(a.ts = lts AND a.id > lid))) AS BIGINT) AS trailing_failures, max(CASE WHEN NOT success THEN a.ts END) "
                    "AS last_failure_ts FROM attempts a JOIN lastok l ON a.site = l.site GROUP BY a.site)")


@query("A5", TRAIL_SQL + f"SELECT site, trailing_failures, strftime(last_failure_ts, '%Y-%m-%d %H:%M:%S.%f') AS last_failure_ts FROM trail")
def a5(spark, sf):
    t = dedup.trailing_failures(tb.attempts(spark, sf))
    return t.select("site", "trailing_failures", F.date_format("last_failure_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_failure_ts"))


@query("A7", d.with_(d.ATTEMPTS) + "SELECT site, run_no, CAST(count(*) AS BIGINT) AS run_length, "
       "strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS run_start, strftime(max(CASE WHEN k = 5 THEN ts END), "
       "'%Y-%m-%d %H:%M:%S.%f') AS opened_at FROM (SELECT *, row_number() OVER (PARTITION BY site, run_no ORDER BY ts, id) AS k "
       "FROM (SELECT *, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY ts, id ROWS BETWEEN "
       "UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_no FROM attempts) WHERE NOT success) GROUP BY site, run_no")
def a7(spark, sf):
    r = dedup.failure_runs(tb.attempts(spark, sf))
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return r.select("site", F.col("run_no").cast("bigint").alias("run_no"), "run_length",
                    F.date_format("run_start", fmt).alias("run_start"), F.date_format("opened_at", fmt).alias("opened_at"))


@query("G1", J + "SELECT norm_title, norm_company, cnt, id, stage FROM (SELECT lower(trim(title)) AS norm_title, "
       "lower(trim(company)) AS norm_company, count(*) OVER (PARTITION BY lower(trim(title)), lower(trim(company))) AS cnt, "
       "id, stage FROM jobs) WHERE cnt > 1")
def g1(spark, sf):
    return dedup.duplicate_groups(tb.jobs(spark, sf))


@query("G2", J + "SELECT stage, count(*) AS n FROM jobs GROUP BY stage")
def g2(spark, sf):
    return reports.stage_counts(tb.jobs(spark, sf))


@query("G3", SCORED_JOBS + "SELECT count(*) FILTER (WHERE score >= 95) AS tier_95, count(*) FILTER (WHERE score >= 85 "
       "AND score < 95) AS tier_85, count(*) FILTER (WHERE score >= 70 AND score < 85) AS tier_70 FROM sj WHERE stage = 'To Apply'")
def g3(spark, sf):
    j = tb.jobs(spark, sf).where(F.col("stage") == "To Apply").withColumn("score", ev.parse_score(F.col("ai_summary")))
    return reports.score_tiers(j)


@query("G5", d.with_(d.ATTEMPTS) + "SELECT count(*) FILTER (WHERE success) AS tasks_succeeded, count(*) AS tasks, "
       "CAST(coalesce(sum(jobs_found), 0) AS BIGINT) AS jobs_found FROM attempts")
def g5(spark, sf):
    return reports.scrape_totals(tb.attempts(spark, sf))


SITE_METRICS_SQL = TRAIL_SQL.replace("WITH ", "WITH ", 1)[:-1] + (
    ", m AS (SELECT site, count(*) AS total_requests, count(*) FILTER (WHERE success) AS successful_requests, "
    "CAST(coalesce(sum(CASE WHEN success THEN jobs_found END), 0) AS BIGINT) AS total_jobs_found, "
    "coalesce(sum(CASE WHEN success THEN response_time_ms END), 0.0) AS total_response_time, "
    "max(CASE WHEN success THEN ts END) AS last_success, "
    "arg_max(error, CASE WHEN NOT success THEN (ts, id) END) AS last_fail_reason FROM attempts GROUP BY site), "
    "sm AS (SELECT m.*, t.trailing_failures AS failures_in_a_row, CASE WHEN total_requests > 0 THEN "
    "successful_requests / total_requests ELSE 1.0 END AS success_rate, CASE WHEN total_requests > 0 THEN "
    "total_response_time / total_requests ELSE 0.0 END AS avg_response_ms FROM m JOIN trail t ON m.site = t.site) ")


@query("G6", SITE_METRICS_SQL + "SELECT site, total_requests, successful_requests, total_jobs_found, "
       "round(total_response_time, 3) AS total_response_time, failures_in_a_row, last_fail_reason, "
       "round(success_rate, 6) AS success_rate, round(avg_response_ms, 3) AS avg_response_ms FROM sm")
def g6(spark, sf):
    m = reports.site_metrics(tb.attempts(spark, sf))
    return m.select("site", "total_requests", "successful_requests", "total_jobs_found",
                    F.round("total_response_time", 3).alias("total_response_time"), "failures_in_a_row", "last_fail_reason",
                    F.round("success_rate", 6).alias("success_rate"), F.round("avg_response_ms", 3).alias("avg_response_ms"))


NOW_SQL = "(SELECT max(ts) FROM attempts)"


# the breaker as a recursive replay of every attempt, one after another
_GAP = f"epoch_us(s.ts) - epoch_us(r.lf) > {rules.BREAKER_RECOVERY_SECONDS} * 1000000"
REPLAY_SQL = d.with_(d.ATTEMPTS).replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + (
    ", seqd AS (SELECT site, ts, success, row_number() OVER (PARTITION BY site ORDER BY ts, id) AS rn FROM attempts), "
    "replay(site, rn, c, lf) AS (SELECT DISTINCT site, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP) FROM attempts "
    "UNION ALL SELECT s.site, s.rn, CASE WHEN s.success THEN 0 WHEN r.c >= " + str(rules.BREAKER_THRESHOLD) + f" AND {_GAP} THEN 1 "
    "ELSE r.c + 1 END, CASE WHEN s.success THEN r.lf ELSE s.ts END FROM replay r JOIN seqd s ON s.site = r.site AND s.rn = r.rn + 1), "
    f"ended AS (SELECT site, arg_max(c, rn) AS c, epoch_us({NOW_SQL}) - epoch_us(max(lf)) > {rules.BREAKER_RECOVERY_SECONDS} * 1000000 AS old "
    "FROM replay GROUP BY site), "
    f"breaker AS (SELECT site, CASE WHEN c >= {rules.BREAKER_THRESHOLD} AND old THEN 0 ELSE c END AS trailing_failures, "
    f"c >= {rules.BREAKER_THRESHOLD} AND NOT coalesce(old, true) AS is_open FROM ended) ")


@query("G7", REPLAY_SQL + "SELECT site, trailing_failures, is_open FROM breaker")
def g7(spark, sf):
    a = tb.attempts(spark, sf)
    now = a.agg(F.max("ts")).scalar()
    return reports.breaker_state(a, now)


@query("G8", SITE_METRICS_SQL + "SELECT site, CASE WHEN failures_in_a_row >= 15 THEN 'circuit_open' WHEN failures_in_a_row >= 5 "
       "THEN 'failing' WHEN success_rate < 0.5 THEN 'degraded' ELSE 'healthy' END AS health, "
       "round_even(success_rate * 100, 1) AS success_rate, round_even(avg_response_ms, 1) AS avg_response_ms, "
       "total_requests, total_jobs_found AS jobs_found FROM sm")
def g8(spark, sf):
    return reports.health_report(reports.site_metrics(tb.attempts(spark, sf)))


@query("G9", d.with_(d.JOBS) + "SELECT company_key, n_jobs, first_id FROM (SELECT lower(" + d.strip("company") + ") AS company_key, "
       "count(*) AS n_jobs, arg_min(id, (CASE WHEN stage = 'To Apply' THEN 0 ELSE 1 END, -epoch_us(date_found), id)) AS first_id "
       "FROM jobs WHERE stage IN ('To Apply', 'In Process') AND lower(" + d.strip("company") + ") <> '' GROUP BY 1)")
def g9(spark, sf):
    idx = joins.company_index(filters.active_jobs(tb.jobs(spark, sf)))
    return idx.select("company_key", "n_jobs", F.col("company_ord.id").alias("first_id"))


@query("G10", J + "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS removed FROM (SELECT count(*) AS n FROM jobs "
       "GROUP BY lower(trim(title)), lower(trim(company)))")
def g10(spark, sf):
    return dedup.dedup_removed_count(tb.jobs(spark, sf))


@query("K1", J + f"SELECT id, {sday('date_found')} AS day, row_number() OVER (ORDER BY date_found DESC, id) AS position "
       "FROM jobs WHERE stage = 'To Apply'")
def k1(spark, sf):
    return reports.jobs_by_stage(tb.jobs(spark, sf), "To Apply").select("id", day(F.col("date_found")).alias("day"), "position")


@query("K2", SCORED_JOBS + "SELECT stage, id, score, row_number() OVER (PARTITION BY stage ORDER BY score DESC, "
       "date_found DESC, id) AS position FROM sj WHERE stage IN ('To Apply', 'Applied', 'In Process', 'Declined')")
def k2(spark, sf):
    return reports.kanban_board(tb.jobs(spark, sf)).select("stage", "id", "score", "position")


@query("K3", SCORED_JOBS + "SELECT id, url, score FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, id) "
       "AS rn FROM sj WHERE stage = 'To Apply') WHERE rn = 1 ORDER BY score DESC, id LIMIT 5")
def k3(spark, sf):
    return reports.top_jobs(tb.jobs(spark, sf)).select("id", "url", "score")


@query("K4", SCORED_JOBS + "SELECT id, score FROM sj WHERE stage = 'To Apply' ORDER BY score DESC, id LIMIT 3")
def k4(spark, sf):
    j = tb.jobs(spark, sf).where(F.col("stage") == "To Apply").withColumn("score", ev.parse_score(F.col("ai_summary")))
    return reports.top_new_matches(j).select("id", "score")


@query("U2", J + "SELECT id, stage, row_number() OVER (ORDER BY CASE WHEN stage = 'To Apply' THEN 0 ELSE 1 END, "
       "date_found DESC, id) AS active_position FROM jobs WHERE stage IN ('To Apply', 'In Process')")
def u2(spark, sf):
    a = joins.active_order(filters.active_jobs(tb.jobs(spark, sf)))
    pos = reports.global_positions(a.withColumn("_g", F.lit(1)), ["_g"], [F.col("active_ord")], out="active_position")
    return pos.select("id", "stage", "active_position")


# ---------------------------------------------------------------------------
# 2.3 joins
# ---------------------------------------------------------------------------
B_CANON = d.canonical_url("batch", "url", "f1", False, "id, title, company")
SEEN_URL = "EXISTS (SELECT 1 FROM store s WHERE s.url = b.f1)"
SEEN_TC = ("(coalesce(b.title, '') <> '' AND coalesce(b.company, '') <> '' AND EXISTS (SELECT 1 FROM store s "
           "WHERE lower(trim(s.title)) = lower(trim(b.title)) AND lower(trim(s.company)) = lower(trim(b.company))))")


@query("J1", STORE_BATCH + f"SELECT id FROM ({B_CANON}) b WHERE NOT {SEEN_URL} AND NOT {SEEN_TC}")
def j1(spark, sf):
    store, batch = tb.store_and_batch(spark, sf)
    return joins.drop_seen(batch, store).select("id")


@query("J2", STORE_BATCH + f"SELECT id, CASE WHEN {SEEN_URL} THEN 'url' WHEN {SEEN_TC} THEN 'title_company' END AS seen_by "
       f"FROM ({B_CANON}) b")
def j2(spark, sf):
    store, batch = tb.store_and_batch(spark, sf)
    return joins.is_processed(batch, store).select("id", "seen_by")


@query("J1_index", ORACLE["J1"])
def j1_index(spark, sf):
    index, batch = _store_index(spark, sf)
    return joins.drop_seen(batch, None, index=index).select("id")


@query("J2_index", ORACLE["J2"])
def j2_index(spark, sf):
    index, batch = _store_index(spark, sf)
    return joins.is_processed(batch, None, index=index).select("id", "seen_by")


MATCH_SQL = d.with_(
    d.MAIL_JOBS, d.MESSAGES,
    "active AS (SELECT * FROM mail_jobs WHERE stage IN ('To Apply', 'In Process'))",
    "idx AS (SELECT lower(" + d.strip("company") + ") AS company_key, min({'b': CASE WHEN stage = 'To Apply' THEN 0 "
    "ELSE 1 END, 'd': -epoch_us(date_found), 'id': id}) AS ord FROM active WHERE lower(" + d.strip("company") + ") <> '' "
    "GROUP BY 1)",
    "m AS (SELECT seq, lower(coalesce(sender, 'None')) AS s, lower(coalesce(subject, 'None')) AS j FROM messages)",
    "hits AS (SELECT m.seq, i.company_key, i.ord, 1 AS tier FROM m JOIN idx i ON contains(m.s, i.company_key) "
    "OR contains(m.j, i.company_key) UNION ALL SELECT m.seq, i.company_key, i.ord, 2 AS tier FROM m JOIN idx i "
    "ON len(list_filter(string_split(i.company_key, ' '), lambda p: length(p) > 2 AND contains(m.s, p))) > 0)",
    "matched AS (SELECT seq, arg_min(company_key, {'t': tier, 'o': ord}) AS company_key, min(tier) AS tier "
    "FROM hits GROUP BY seq)")


def _matched(spark, sf):
    active = filters.active_jobs(tb.mail_jobs(spark, sf))
    return joins.match_company(tb.messages(spark, sf), joins.company_index(active)), active


@query("J3", MATCH_SQL + "SELECT seq, company_key, tier FROM matched")
def j3(spark, sf):
    return _matched(spark, sf)[0].select("seq", "company_key", "tier")


@query("J4", MATCH_SQL + "SELECT m.seq, a.id, m.company_key FROM (SELECT company_key, max(seq) AS seq FROM matched GROUP BY company_key) m "
       "JOIN active a ON lower(" + d.strip("a.company") + ") = m.company_key")
def j4(spark, sf):
    """Every job of a company gets the same messages, and the last one decides: one row a job."""
    matched, active = _matched(spark, sf)
    latest = matched.groupBy("company_key").agg(F.max("seq").alias("seq"))
    return joins.fan_out_updates(latest, active).select("seq", "id", "company_key")


@query("J5", d.with_(d.ATTEMPTS, QUERIES_SQL) + "SELECT s.site, qs.query, qs.query_ord FROM (SELECT DISTINCT site FROM attempts) s, qs")
def j5(spark, sf):
    sites = tb.attempts(spark, sf).select("site").distinct()
    return joins.plan_crawl(sites).select("site", "query", "query_ord")


TASKS_SQL = d.with_(d.ATTEMPTS, "tasks AS (SELECT DISTINCT site, query FROM attempts)")
FRESH_SQL = (f"(SELECT max(ts) FROM attempts) < ts + INTERVAL {rules.CACHE_TTL_SECONDS} SECOND")


def _now(df: DataFrame) -> Column:
    """The run's reference time: a one-value aggregate, as a scalar subquery."""
    return df.agg(F.max("ts")).scalar()


@query("J6", TASKS_SQL + "SELECT site, query, md5(site || ':' || query) AS task_key FROM tasks WHERE md5(site || ':' || query) "
       f"NOT IN (SELECT md5(site || ':' || query) FROM attempts WHERE success AND {FRESH_SQL})")
def j6(spark, sf):
    a = tb.attempts(spark, sf)
    tasks = a.select("site", "query").distinct()
    results = a.where(F.col("success")).withColumnRenamed("ts", "fetched_at")
    to_fetch, _ = joins.skip_fresh(tasks, results, _now(a))
    return to_fetch.select("site", "query", "task_key")


@query("J7", REPLAY_SQL[:-1] + ", tasks AS (SELECT DISTINCT site, query FROM attempts) SELECT site, query FROM tasks WHERE site NOT IN "
       "(SELECT site FROM breaker WHERE is_open)")
def j7(spark, sf):
    a = tb.attempts(spark, sf)
    tasks = a.select("site", "query").distinct()
    return joins.skip_open_circuits(tasks, reports.breaker_state(a, _now(a))).select("site", "query")


# ---------------------------------------------------------------------------
# 2.4 / 2.6 / 2.7: G4, K5, U1, U3
# ---------------------------------------------------------------------------
P11_DESC = f"(SELECT *, {P11_EXPR} AS reason, {F18_SCORE} AS score FROM described)"
GEO_COUNT = f"(SELECT count(*) FROM (SELECT {GEO_REASON} AS g FROM jobs) WHERE g IS NOT NULL)"


def _matches(spark, sf):
    """New matches of a scan over the described postings: not rejected,
    scored, routed To Apply."""
    pf = filters.pre_filter(tb.described(spark, sf)).where(~F.col("is_rejected"))
    e = F.col("evaluation")
    s = scoring.score_postings(pf).select("id", "title", "company", "url", "location", "description",
                                          e["match_score"].alias("score"), e["is_relevant"].alias("is_relevant"),
                                          scoring.evaluation_json(e).alias("ai_summary"))
    return s.where(ev.route_by_score(F.col("is_relevant"), F.col("score")) == "To Apply")


G4_CTES = (d.JOBS, d.DESCRIBED, f"mt AS (SELECT * FROM {P11_DESC} WHERE reason IS NULL AND score >= 70)")


@query("G4", d.with_(*G4_CTES)
       + "SELECT (SELECT count(*) FROM described) AS total_scanned, (SELECT count(*) FROM mt) AS new_matches, "
       "(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM jobs GROUP BY lower(trim(title)), "
       f"lower(trim(company)))) AS duplicates_removed, {GEO_COUNT} AS geo_filtered, "
       "(SELECT count(*) FROM jobs WHERE stage = 'To Apply') AS total_to_apply, "
       "(SELECT count(*) FROM mt WHERE score >= 95) AS tier_95, (SELECT count(*) FROM mt WHERE score >= 85 AND score < 95) "
       "AS tier_85, (SELECT count(*) FROM mt WHERE score >= 70 AND score < 85) AS tier_70")
def g4(spark, sf):
    j = tb.jobs(spark, sf)
    geo = filters.apply_geo_filter(j).agg(F.count_if(F.col("geo_reason").isNotNull()).cast("bigint").alias("geo_filtered"))
    return reports.scan_summary(tb.described(spark, sf), _matches(spark, sf), dedup.dedup_removed_count(j), geo, j)


@query("K5", d.with_(d.ATTEMPTS) + "SELECT task_key, strftime(expiry, '%Y-%m-%d %H:%M:%S.%f') AS expiry FROM (SELECT "
       f"md5(site || ':' || query) AS task_key, max(ts) + INTERVAL {rules.CACHE_TTL_SECONDS} SECOND AS expiry FROM attempts "
       f"WHERE success GROUP BY 1) ORDER BY expiry DESC, task_key LIMIT {rules.CACHE_MAX_ENTRIES}")
def k5(spark, sf):
    a = tb.attempts(spark, sf).where(F.col("success")).withColumn("task_key", urls.task_key(F.col("site"), F.col("query")))
    latest = dedup.keep_best(a, ["task_key"], [-F.unix_micros(F.col("ts"))])
    entries = latest.select("task_key", (F.col("ts") + F.make_dt_interval(secs=F.lit(rules.CACHE_TTL_SECONDS))).alias("expiry"))
    out = reports.evict_cache(entries, rules.CACHE_MAX_ENTRIES)
    return out.select("task_key", F.date_format("expiry", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("expiry"))


@query("U1", d.with_(d.CARDS, d.DESCRIBED) + "SELECT site, query, position, title, url FROM cards UNION ALL "
       "SELECT 'described' AS site, company AS query, CAST(id AS INTEGER) AS position, title, NULL AS url FROM described")
def u1(spark, sf):
    cards = html.extract_list_cards(tb.read(spark, sf, "pages")).select("site", "query", "position", "title", "url")
    other = tb.described(spark, sf).select(F.lit("described").alias("site"), F.col("company").alias("query"),
                                           F.col("id").cast("int").alias("position"), "title")
    return joins.union_sources(cards, other).select("site", "query", "position", "title", "url")


@query("U3", DESC + f"SELECT id, 'Irrelevant' AS stage, 0 AS match_score FROM {P11_DESC} WHERE reason IS NOT NULL "
       f"UNION ALL SELECT id, CASE WHEN score >= 70 THEN 'To Apply' ELSE 'Irrelevant' END AS stage, score AS match_score "
       f"FROM {P11_DESC} WHERE reason IS NULL")
def u3(spark, sf):
    pf = filters.pre_filter(tb.described(spark, sf))
    rejected = pf.where(F.col("is_rejected")).select("id", F.lit("Irrelevant").alias("stage"), F.lit(0).alias("match_score"))
    e = F.col("evaluation")
    scored = scoring.score_postings(pf.where(~F.col("is_rejected"))).select(
        "id", ev.route_by_score(e["is_relevant"], e["match_score"]).alias("stage"), e["match_score"].alias("match_score"))
    return joins.union_outcomes(rejected, scored)


# ---------------------------------------------------------------------------
# 2.8 scalar functions: F6, F8-F10, F12-F14, F16, F17
# ---------------------------------------------------------------------------
F6_OK = (f"({d.is_obj('ai_summary')} AND (TRY_CAST(json_extract_string({d.valid('ai_summary')}, '$.match_score') AS INTEGER) "
         f"IS NOT NULL OR json_extract({d.valid('ai_summary')}, '$.match_score') IS NULL))")


@query("F6", J + f"SELECT id, CASE WHEN {F6_OK} THEN {d.relevant('ai_summary')} ELSE false END AS is_relevant, "
       f"CASE WHEN {F6_OK} THEN {d.score('ai_summary')} ELSE 0 END AS match_score, "
       f"CASE WHEN {F6_OK} THEN json_extract_string({d.valid('ai_summary')}, '$.summary') ELSE 'Error: invalid JSON from AI.' "
       "END AS summary FROM jobs")
def f6(spark, sf):
    e = ev.coerce_evaluation(F.col("ai_summary"))
    return tb.jobs(spark, sf).select("id", e["is_relevant"].alias("is_relevant"), e["match_score"].alias("match_score"),
                                     e["summary"].alias("summary"))


# classifier output text built from the events (fenced for a third, broken for a few)
CLASS_TEXT = [
    "event_id AS seq",
    "CASE WHEN event_id % 17 = 0 THEN 'no json here' ELSE "
    "CASE WHEN event_id % 3 = 0 THEN '```json' || chr(10) ELSE '' END || "
    "'{\"is_relevant_update\": ' || CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'true' ELSE 'false' END || "
    "', \"new_stage\": ' || CASE event_type WHEN 'purchase' THEN '\"Declined\"' WHEN 'error' THEN 'null' "
    "ELSE '\"In Process\"' END || ', \"new_sub_stage\": ' || CASE event_type WHEN 'click' THEN '\"HR Screen\"' "
    "WHEN 'view' THEN '\"Tech Interview\"' ELSE 'null' END || ', \"reasoning\": \"' || event_type || '\"}' || "
    "CASE WHEN event_id % 3 = 0 THEN chr(10) || '```' ELSE '' END END AS raw",
]
CLASS_SQL = d.with_(d.cte("cls", CLASS_TEXT, "events"))
F8_SQL = "regexp_replace(regexp_replace(raw, '^`+|`+$', '', 'g'), '^json' || chr(10), '')"


@query("F8", CLASS_SQL + f"SELECT seq, {F8_SQL} AS text FROM cls")
def f8(spark, sf):
    c = tb.read(spark, sf, "events").selectExpr(*CLASS_TEXT)
    return c.select("seq", ev.strip_code_fence(F.col("raw")).alias("text"))


@query("F9", CLASS_SQL + f"SELECT seq, CASE WHEN ok THEN TRY_CAST(json_extract(t, '$.is_relevant_update') AS BOOLEAN) END "
       "AS is_relevant_update, CASE WHEN ok THEN json_extract_string(t, '$.new_stage') END AS new_stage, "
       "CASE WHEN ok THEN json_extract_string(t, '$.new_sub_stage') END AS new_sub_stage FROM (SELECT seq, "
       f"CASE WHEN json_valid({F8_SQL}) THEN {F8_SQL} END AS t, coalesce(json_type(CASE WHEN json_valid({F8_SQL}) "
       f"THEN {F8_SQL} END) = 'OBJECT', false) AS ok FROM cls)")
def f9(spark, sf):
    c = tb.read(spark, sf, "events").selectExpr(*CLASS_TEXT)
    p = ev.parse_classification(F.col("raw"))
    return c.select("seq", p["is_relevant_update"].alias("is_relevant_update"), p["new_stage"].alias("new_stage"),
                    p["new_sub_stage"].alias("new_sub_stage"))


# evaluation field values in the shapes a scorer returns: list, text, object with a
# list, object without, number, JSON string, hand-written list, Python literal
F10_WORDS = "replace(p_type, ' ', '\", \"')"
F10_VALUE = ("CASE p_partkey % 8 WHEN 0 THEN '[\"' || " + F10_WORDS + " || '\", \"\", null, 7, true]' WHEN 1 THEN p_type "
             "WHEN 2 THEN '{\"bullet_points\": [\"' || " + F10_WORDS + " || '\"]}' "
             "WHEN 3 THEN ' {\"zeta_key\": \"' || p_type || '\", \"empty\": \"\", \"a_list\": [\"x\", 2]} ' WHEN 4 THEN '85' "
             "WHEN 5 THEN '\"' || p_type || '\"' WHEN 6 THEN '[' || replace(p_type, ' ', ', ') || ', c d]' "
             "ELSE '[' || chr(39) || replace(p_type, ' ', chr(39) || ', ' || chr(39)) || chr(39) || ', None, 3]' END")
_F10_LINES = "'- ' || replace(p_type, ' ', chr(10) || '- ')"


@query("F10", f"SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN {_F10_LINES} || chr(10) || '- 7' || chr(10) || '- True' WHEN 1 THEN p_type "
       f"WHEN 2 THEN {_F10_LINES} WHEN 3 THEN '- **Zeta Key:** ' || p_type || chr(10) || '- **A List:** [' || chr(39) || 'x' || chr(39) || ', 2]' "
       f"WHEN 4 THEN NULL WHEN 5 THEN p_type WHEN 6 THEN {_F10_LINES} || chr(10) || '- c d' ELSE {_F10_LINES} || chr(10) || '- 3' END AS formatted FROM part")
def f10(spark, sf):
    v = tb.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(F10_VALUE).alias("value"))
    return v.select("id", ev.format_field(F.col("value")).alias("formatted"))


@query("F12", d.with_(d.ATTEMPTS) + f"SELECT id, {FRESH_SQL} AS fresh FROM attempts WHERE success")
def f12(spark, sf):
    a = tb.attempts(spark, sf)
    return a.where(F.col("success")).select("id", joins.is_fresh(F.col("ts"), _now(a)).alias("fresh"))


@query("F13", d.with_(d.MAIL_JOBS) + "SELECT DISTINCT lower(" + d.strip("company") + ") AS company_key, array_to_string(list_filter("
       "string_split(lower(" + d.strip("company") + "), ' '), lambda p: length(p) > 2), '|') AS parts FROM mail_jobs")
def f13(spark, sf):
    keys = tb.mail_jobs(spark, sf).select(joins.company_key(F.col("company")).alias("company_key")).distinct()
    return keys.select("company_key", F.array_join(joins.word_parts(F.col("company_key")), "|").alias("parts"))


JOB_MSG = ("'\U0001F916 *New Job Match!*' || chr(10) || chr(10) || '*' || title || '* at ' || company || chr(10) || "
           "'\U0001F4CD ' || {loc} || ' | \U0001F3AF Score: ' || {score} || '/100' || chr(10) || '✨ ' || {feat} || "
           "chr(10) || chr(10) || 'Summary: ' || {summ} || chr(10) || chr(10) || 'Apply here: ' || url")


def _listed(spark, sf):
    """The jobs, some with list or null fields in their evaluation."""
    return tb.jobs(spark, sf).withColumn("ai_summary", F.expr(d.LISTED_SUMMARY))


@query("F14", d.with_(d.JOBS, d.LISTED) + "SELECT id, " + JOB_MSG.format(
    loc=d.py_text("ai_summary", "location", rules.NOT_SPECIFIED), score=d.py_text("ai_summary", "match_score", "None"),
    feat=d.py_text("ai_summary", "key_features", "N/A"), summ=d.py_text("ai_summary", "summary", "None")) + " AS message FROM listed")
def f14(spark, sf):
    return reports.render_job_message(_listed(spark, sf))


FALSY = "('', 'None', '[]')"
TOP_ITEM = ("'*' || rk || '. ' || coalesce(title, 'Unknown') || '*' || chr(10) || '   @ ' || coalesce(company, 'Unknown') "
            "|| chr(10) || '   Score: ' || score || '/100 | ' || {loc} || chr(10) || CASE WHEN {summ} NOT IN " + FALSY + " THEN '   ' || "
            "{summ} || chr(10) ELSE '' END || CASE WHEN {feat} NOT IN " + FALSY + " THEN '   ' || {feat} || chr(10) ELSE '' END || "
            "'   Apply: ' || coalesce(url, '') || chr(10) || chr(10)")


@query("F16", d.with_(d.JOBS, d.LISTED, f"sj AS (SELECT *, {d.score('ai_summary')} AS score FROM listed)")
       + "SELECT regexp_replace('*Top ' || count(*) || ' Job Matches*' || chr(10) || chr(10) || "
       "coalesce(string_agg(item, '' ORDER BY rk), ''), '^\\s+|\\s+$', '', 'g') AS message FROM (SELECT *, "
       + TOP_ITEM.format(loc=d.py_text("ai_summary", "location", rules.NOT_SPECIFIED), summ=d.py_text("ai_summary", "summary", ""),
                         feat=d.py_text("ai_summary", "key_features", "")) +
       " AS item FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rk FROM (SELECT *, row_number() OVER "
       "(PARTITION BY url ORDER BY score DESC, id) AS rn FROM sj WHERE stage = 'To Apply') WHERE rn = 1 ORDER BY score DESC, "
       "id LIMIT 40))")
def f16(spark, sf):
    return reports.render_top_jobs(reports.top_jobs(_listed(spark, sf), 40))


@query("F17", SITE_METRICS_SQL + "SELECT site, round(success_rate, 6) AS success_rate, round(avg_response_ms, 3) "
       "AS avg_response_ms FROM sm")
def f17(spark, sf):
    m = reports.site_metrics(tb.attempts(spark, sf))
    return m.select("site", F.round("success_rate", 6).alias("success_rate"), F.round("avg_response_ms", 3).alias("avg_response_ms"))


# ---------------------------------------------------------------------------
# mail: X2 (classification), P21 (relevant updates)
# ---------------------------------------------------------------------------
KW = d.keyword_classification("subject", "body")


@query("X2", d.with_(d.MESSAGES) + f"SELECT seq, {KW['is_relevant_update']} AS is_relevant_update, {KW['new_stage']} AS new_stage, "
       f"{KW['new_sub_stage']} AS new_sub_stage, {KW['reasoning']} AS reasoning FROM messages")
def x2(spark, sf):
    c = scoring.classify_messages(tb.messages(spark, sf))
    k = F.col("classification")
    return c.select("seq", k["is_relevant_update"].alias("is_relevant_update"), k["new_stage"].alias("new_stage"),
                    k["new_sub_stage"].alias("new_sub_stage"), k["reasoning"].alias("reasoning"))


@query("P21", d.with_(d.MESSAGES) + f"SELECT seq, {KW['new_stage']} AS new_stage, {KW['new_sub_stage']} AS new_sub_stage "
       f"FROM messages WHERE {KW['is_relevant_update']}")
def p21(spark, sf):
    c = scoring.classify_messages(tb.messages(spark, sf))
    k = F.col("classification")
    return filters.relevant_updates(c).select("seq", k["new_stage"].alias("new_stage"), k["new_sub_stage"].alias("new_sub_stage"))


# ---------------------------------------------------------------------------
# The same round scheme as a recursive CTE (each iteration takes the
# undecided items, admits those first in both their URL and title groups and
# rejects those sharing a key with a newly admitted one, until none is left)
# ---------------------------------------------------------------------------
A6_SQL = d.with_(d.ARRIVALS).replace("WITH ", "WITH RECURSIVE ", 1) + (
    ", items AS (SELECT seq, url, title, coalesce(url, chr(2) || CAST(seq AS VARCHAR)) AS u, "
    "CASE WHEN coalesce(title, '') <> '' AND coalesce(company, '') <> '' THEN lower(trim(title)) || chr(1) || "
    "lower(trim(company)) END AS tk FROM arrivals), "
    "rounds(seq, u, tk, st) AS (SELECT seq, u, tk, 'U' FROM items UNION ALL "
    "SELECT seq, u, tk, CASE WHEN adm THEN 'A' WHEN hit_u OR hit_t THEN 'R' ELSE 'U' END FROM ("
    "SELECT *, bool_or(adm) OVER (PARTITION BY u) AS hit_u, "
    "CASE WHEN tk IS NULL THEN false ELSE bool_or(adm) OVER (PARTITION BY tk) END AS hit_t FROM ("
    "SELECT seq, u, tk, (seq = min(seq) OVER (PARTITION BY u) AND (tk IS NULL OR seq = min(seq) OVER (PARTITION BY tk))) "
    "AS adm FROM rounds WHERE st = 'U') a) b) "
    "SELECT i.seq, i.url, i.title FROM items i JOIN rounds r ON i.seq = r.seq AND r.st = 'A'")


@query("A6", A6_SQL)
def a6(spark, sf):
    return dedup.admit_batch(tb.arrivals(spark, sf)).select("seq", "url", "title")


# ---------------------------------------------------------------------------
# composites: F15, X3, X4
# ---------------------------------------------------------------------------
def _f15_sql() -> str:
    g4_select = ORACLE["G4"][len(d.with_(*G4_CTES)):]
    head = _sql_text(reports.SUMMARY_HEAD)
    for col, label in reports.SUMMARY_KPIS:
        head += f" || {_sql_text(label)} || CAST({col} AS VARCHAR) || chr(10)"
    head += f" || {_sql_text(reports.SUMMARY_TIER_HEAD)}"
    for col, label in reports.SUMMARY_TIERS:
        head += f" || {_sql_text(label)} || CAST({col} AS VARCHAR) || chr(10)"
    item = (f"'  ' || rk || '. *' || title || '* @ ' || company || {_sql_text(reports.PICK_LOCATION)} || location || "
            f"{_sql_text(reports.PICK_SCORE)} || score || '/100' || chr(10) || {_sql_text(reports.PICK_LINK)} || url || chr(10)")
    picks = (f"picks AS (SELECT string_agg(item, '' ORDER BY rk) AS p FROM (SELECT *, {item} AS item FROM (SELECT *, "
             "row_number() OVER (ORDER BY score DESC, id) AS rk FROM (SELECT * FROM mt ORDER BY score DESC, id LIMIT 3))))")
    msg = (f"{head} || CASE WHEN coalesce(p, '') <> '' THEN {_sql_text(reports.SUMMARY_PICKS_HEAD)} || p ELSE '' END")
    return (d.with_(*G4_CTES, f"g AS ({g4_select})", picks)
            + f"SELECT regexp_replace(msg, '^\\s+|\\s+$', '', 'g') AS message FROM (SELECT {msg} AS msg "
            "FROM g, picks)")


@query("F15", _f15_sql())
def f15(spark, sf):
    j = tb.jobs(spark, sf)
    geo = filters.apply_geo_filter(j).agg(F.count_if(F.col("geo_reason").isNotNull()).cast("bigint").alias("geo_filtered"))
    matches = _matches(spark, sf)
    summary = reports.scan_summary(tb.described(spark, sf), matches, dedup.dedup_removed_count(j), geo, j)
    return reports.render_scan_summary(summary, reports.top_new_matches(matches))


X3_EVAL = ("'{\"is_relevant\": ' || CASE WHEN score >= 70 THEN 'true' ELSE 'false' END || ', \"match_score\": ' || "
           "CAST(score AS VARCHAR) || ', \"summary\": ' || " + d.dumps_str("'Rule score for ' || coalesce(title, '')")
           + " || ', \"location\": ' || " + d.dumps_str("coalesce(location, " + d.q(rules.NOT_SPECIFIED) + ")")
           + " || ', \"key_features\": \"\", \"important_qualifications\": \"\"}'")


@query("X3", d.with_(d.JOBS, "rc AS (SELECT id, title, company, url, CASE WHEN " + d.is_obj("ai_summary") + " THEN "
       + d.field("ai_summary", "location", rules.NOT_SPECIFIED) + " ELSE " + d.q(rules.NOT_SPECIFIED) + " END AS location, "
       + RECHECK_DESC + " AS description FROM jobs WHERE stage IN ('To Apply', 'Irrelevant'))",
       f"pr AS (SELECT *, {P11_EXPR} AS reason, {F18_SCORE} AS score FROM rc)")
       + "SELECT id, CASE WHEN reason IS NULL AND score >= 70 THEN 'To Apply' ELSE 'Irrelevant' END AS stage, "
       f"CASE WHEN reason IS NOT NULL THEN {d.rejected_eval('reason', 'location')} ELSE {X3_EVAL} END AS ai_summary FROM pr")
def x3(spark, sf):
    return cycle.recheck(tb.jobs(spark, sf)).select("id", "stage", "ai_summary")


def _cycle_inputs(spark, sf):
    store, batch = tb.store_and_batch(spark, sf)
    kinds = F.array(*[F.lit(k) for k in ("student position", "entry level role", "junior developer", "position")])
    postings = batch.select(F.col("id").alias("seq"), "title", "company", "url", "location",
                            F.concat_ws(" ", F.col("title"), F.element_at(kinds, (F.floor(F.col("id") / 2) % 4 + 1).cast("int")))
                            .alias("description"))
    return store, postings


@query("X4")
def x4(spark, sf):
    store, postings = _cycle_inputs(spark, sf)
    out = cycle.run_cycle(store, postings, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return out["store"].select("id", "title", "company", "url", "stage")


# ---------------------------------------------------------------------------
# sources / sinks through files: S4, S10
# ---------------------------------------------------------------------------
@query("S4", d.with_(d.MESSAGES) + "SELECT seq, sender, subject FROM messages")
def s4(spark, sf):
    """Raw messages land as a table; the stream delivers each once, and a replayed
    micro-batch replaces itself."""
    from postline.sources import mail
    from postline.sources.mail import parse_messages, render_rfc822
    data, ck = streams.stream_scratch(spark, "inbox")
    render_rfc822(tb.messages(spark, sf)).write.parquet(f"{data}/raw")
    out = f"{data}/parsed"

    def per_batch(batch, batch_id):
        mail.write_parsed(parse_messages(mail.dealt(batch)), out, batch_id)

    for run in (ck, ck, f"{ck}_again"):      # a second run finds nothing new; without its checkpoint every batch is replayed
        streams.run_available_now(streams.read_message_table_stream(spark, f"{data}/raw").writeStream
                                  .foreachBatch(per_batch), run)
    return spark.read.parquet(out).where(F.col("error").isNull()).select("seq", "sender", "subject")


@query("S10", ORACLE["F14"])
def s10(spark, sf):
    data, _ = streams.stream_scratch(spark, "outbox")
    for _ in range(2):      # delivered again: the batch replaces itself
        state.outbox_sink(reports.render_job_message(_listed(spark, sf)), data, "1")
    return spark.read.parquet(data).select("id", "message")


# ---------------------------------------------------------------------------
# 2.9 streaming: T1-T5 (availableNow runs read back from their sinks)
# ---------------------------------------------------------------------------
@query("T1")
def t1(spark, sf):
    store, postings = _cycle_inputs(spark, sf)
    data, ck = streams.stream_scratch(spark, "ingest")
    postings.write.parquet(f"{data}/incoming")
    streams.seed_table(store, f"{data}/store")
    streams.ingest_stream(spark, f"{data}/incoming", f"{data}/store", ck, postings.schema,
                          now=F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return state.read_latest(spark, f"{data}/store").select("id", "title", "company", "url", "stage")


def _event_stream(spark, sf, data):
    """The events as a stream of ten micro-batches, each with rows of all
    times: most rows arrive after later ones have been seen."""
    events = tb.read(spark, sf, "events")
    events.repartition(10, "event_id").write.parquet(f"{data}/events")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{data}/events")


@query("T2", d.with_(d.ARRIVALS) + "SELECT DISTINCT url FROM arrivals")
def t2(spark, sf):
    n = tb.read(spark, sf, "events").count()
    data, ck = streams.stream_scratch(spark, "dedup")
    s = _event_stream(spark, sf, data).withColumn("n", F.lit(n)).selectExpr(*tb.ARRIVALS)
    streams.dedup_stream(spark, s, f"{data}/out", ck)
    return streams.read_passed(spark, f"{data}/out").select("url")


T3_SQL = MATCH_SQL[:-1] + (
    f", cls AS (SELECT m.seq, m.company_key, {d.keyword_classification('g.subject', 'g.body')['is_relevant_update']} "
    f"AS rel, {d.keyword_classification('g.subject', 'g.body')['new_stage']} AS ns, "
    f"{d.keyword_classification('g.subject', 'g.body')['new_sub_stage']} AS nss "
    "FROM matched m JOIN messages g ON m.seq = g.seq), "
    "fan AS (SELECT a.id, c.seq, c.ns, c.nss FROM cls c JOIN active a ON lower(" + d.strip("a.company") + ") = c.company_key "
    "WHERE c.rel), "
    "latest AS (SELECT id, arg_max({'s': ns, 'ss': nss}, seq) AS u FROM fan GROUP BY id) "
    "SELECT j.id, CASE WHEN l.id IS NOT NULL THEN l.u.s ELSE j.stage END AS stage, "
    "CASE WHEN l.id IS NOT NULL THEN l.u.ss END AS sub_stage FROM mail_jobs j LEFT JOIN latest l ON j.id = l.id")


@query("T3", T3_SQL)
def t3(spark, sf):
    from postline.sources.mail import render_rfc822
    data, ck = streams.stream_scratch(spark, "mail")
    render_rfc822(tb.messages(spark, sf)).write.parquet(f"{data}/raw")
    streams.seed_table(tb.mail_jobs(spark, sf).withColumn("sub_stage", F.lit(None).cast("string")), f"{data}/jobs")
    streams.mail_updates_stream(spark, f"{data}/raw", f"{data}/jobs", ck)
    return state.read_latest(spark, f"{data}/jobs").select("id", "stage", "sub_stage")


LATE = 6 * 3600          # seconds that an attempt of the T4 stream may be late


@query("T4", ORACLE["G7"])
def t4(spark, sf):
    """The attempts land in ten deliveries in the order of their arrival, which is up to ``LATE``
    seconds after their time; the stream is run after each."""
    data, ck = streams.stream_scratch(spark, "breaker")
    events = tb.read(spark, sf, "events")
    arrived = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(LATE))
    first, last = events.agg(F.min(arrived), F.max(arrived)).first()
    delivery = F.floor((arrived - F.lit(first or 0)) * 10 / ((last or 0) - (first or 0) + 1))
    streams.seed_table(spark.createDataFrame([], streams.BREAKER_STATE), f"{data}/state")
    for k in range(10):
        events.where(delivery == k).write.mode("append").parquet(f"{data}/events")
        a = spark.readStream.schema(events.schema).parquet(f"{data}/events").selectExpr(*tb.ATTEMPTS)
        streams.breaker_stream(spark, a, f"{data}/state", ck, horizon_seconds=2 * LATE)
    st = state.read_latest(spark, f"{data}/state")
    return streams.breaker_open(st, _now(tb.attempts(spark, sf)))


@query("K5_stream", ORACLE["K5"])
def k5_stream(spark, sf):
    """The result cache kept over ten micro-batches in no order of time."""
    data, ck = streams.stream_scratch(spark, "cache")
    a = _event_stream(spark, sf, data).selectExpr(*tb.ATTEMPTS)
    streams.seed_table(spark.createDataFrame([], streams.CACHE), f"{data}/cache")
    streams.result_cache_stream(spark, a, f"{data}/cache", ck)
    return state.read_latest(spark, f"{data}/cache").select("task_key", F.date_format("expiry", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("expiry"))


@query("T5", d.with_(d.ATTEMPTS) + "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, site, "
       "count(*) AS attempts, count(*) FILTER (WHERE success) AS successes, CAST(coalesce(sum(jobs_found), 0) AS BIGINT) "
       "AS jobs_found FROM attempts GROUP BY ALL")
def t5(spark, sf):
    data, ck = streams.stream_scratch(spark, "metrics")
    a = _event_stream(spark, sf, data).selectExpr(*tb.ATTEMPTS)
    streams.cycle_metrics_stream(spark, a, f"{data}/out", ck)
    m = streams.read_cycle_metrics(spark, f"{data}/out")
    return m.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "site", "attempts", "successes",
                    "jobs_found")


# T1 = the ingest of the cycle inputs: canonical URLs, admission (the A6
# rounds), seen checks, pre-filter, rule score, routing, ids after the store's
T1_POSTS = ("posts AS (SELECT id AS seq, title, company, url, location, title || ' ' || CASE CAST(floor(id / 2) AS BIGINT) % 4 "
            "WHEN 0 THEN 'student position' WHEN 1 THEN 'entry level role' WHEN 2 THEN 'junior developer' ELSE 'position' END "
            "AS description FROM batch)")
A6_ROUNDS = A6_SQL[A6_SQL.index(", items AS"):A6_SQL.index(" SELECT i.seq")]
T1_SQL = (d.with_(d.JOBS, d.STORE, d.BATCH, T1_POSTS).replace("WITH ", "WITH RECURSIVE ", 1)[:-1]
          + ", canon AS (" + d.canonical_url("posts", "url", "curl", False, "seq, title, company, location, description") + ")"
          + ", arrivals AS (SELECT seq, coalesce(curl, '') AS url, title, company, location, description FROM canon)"
          + A6_ROUNDS
          + ", admitted AS (SELECT a.* FROM arrivals a JOIN rounds r ON a.seq = r.seq AND r.st = 'A')"
          + ", fresh AS (SELECT * FROM admitted b WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.url = b.url) AND NOT "
          + SEEN_TC + ")"
          + f", scored AS (SELECT *, {P11_EXPR} AS reason, {F18_SCORE} AS score FROM fresh)"
          + ", ins AS (SELECT (SELECT max(id) FROM store) + row_number() OVER (ORDER BY seq) AS id, title, company, url, "
          "CASE WHEN reason IS NULL AND score >= 70 THEN 'To Apply' ELSE 'Irrelevant' END AS stage FROM scored) "
          "SELECT id, title, company, url, stage FROM store UNION ALL SELECT id, title, company, url, stage FROM ins")
ORACLE["T1"] = T1_SQL

# X4 = T1's ingest (keeping the evaluation text and location of new rows),
# then dedup (A1) -> demotion (P14) -> geo filter (P13) over the whole table
X4_SQL = (T1_SQL[:T1_SQL.index(", ins AS (")]
          + ", ins AS (SELECT (SELECT max(id) FROM store) + row_number() OVER (ORDER BY seq) AS id, title, company, url, "
          "CASE WHEN reason IS NULL AND score >= 70 THEN 'To Apply' ELSE 'Irrelevant' END AS stage, "
          f"CASE WHEN reason IS NOT NULL THEN {d.rejected_eval('reason', 'location')} ELSE {X3_EVAL} END AS ai_summary, "
          f"coalesce(location, {d.q(rules.NOT_SPECIFIED)}) AS location FROM scored)"
          ", allrows AS (SELECT id, title, company, url, stage, ai_summary, location FROM store UNION ALL "
          "SELECT id, title, company, url, stage, ai_summary, location FROM ins)"
          f", deduped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(title)), "
          f"lower(trim(company)) ORDER BY {RANK} DESC, {d.score('ai_summary')} DESC, id) AS rn FROM allrows) WHERE rn = 1)"
          f", demoted AS (SELECT * REPLACE (CASE WHEN coalesce({DEMOTE}, false) THEN 'Irrelevant' ELSE stage END AS stage) "
          "FROM deduped)"
          f", geo AS (SELECT *, {GEO_REASON} AS geo_reason FROM demoted) "
          "SELECT id, title, company, url, CASE WHEN geo_reason IS NOT NULL THEN 'Irrelevant' ELSE stage END AS stage FROM geo")
ORACLE["X4"] = X4_SQL
