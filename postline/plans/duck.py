"""DuckDB SQL fragments for the oracle side of the query registry.

The oracle re-states each operator in plain SQL on the same parquet
tables; these helpers generate the repetitive parts (rule cascades, URL
canonicalisation, score parsing) from the same rule lists the Spark
operators use, so both sides read one definition of the data.
"""

from __future__ import annotations

from postline import rules
from postline.sources import tables as tb

URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cte(name: str, exprs: list[str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(exprs)} FROM {source})"


JOBS = cte("jobs", tb.JOBS, "part")
MAIL_JOBS = cte("mail_jobs", tb.MAIL_JOBS, "part")
DESCRIBED = cte("described", tb.DESCRIBED, "part")
LOCATED = cte("located", tb.LOCATED,
              "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
ATTEMPTS = cte("attempts", tb.ATTEMPTS, "events")
STAGE_LOG = cte("stage_log", tb.STAGE_LOG, "events")
BOARD = cte("board", tb.BOARD, "orders")
MESSAGES = cte("messages", tb.MESSAGE_COLS,
               "events JOIN part ON event_id % (SELECT count(*) FROM part) = p_partkey")
ARRIVALS = cte("arrivals", tb.ARRIVALS, "events, (SELECT count(*) AS n FROM events) cnt")
STORE = "store AS (SELECT * FROM jobs WHERE id % 2 = 0)"
BATCH = ("batch AS (SELECT id, title, company, CASE WHEN id % 10 = 1 THEN 'https://x.example.com/jobs/' "
         "|| CAST(id - 1 AS STRING) || '?trk=feed' ELSE url END AS url, date_found, ai_summary, stage, sub_stage, location "
         "FROM jobs WHERE id % 2 = 1)")


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def is_obj(js: str) -> str:
    return f"coalesce(json_type({valid(js)}) = 'OBJECT', false)"


def score(js: str) -> str:
    """F4."""
    return (f"(CASE WHEN {is_obj(js)} THEN coalesce(TRY_CAST(json_extract_string({valid(js)}, '$.match_score') AS INTEGER), 0) "
            f"ELSE 0 END)")


def valid(js: str) -> str:
    """The text when it is valid JSON, else NULL (json_extract raises on
    invalid input even under a CASE guard)."""
    return f"(CASE WHEN json_valid({js}) THEN {js} END)"


def score_or_null(js: str) -> str:
    """F5."""
    v = valid(js)
    return (f"(CASE WHEN NOT coalesce({is_obj(js)}, false) THEN NULL "
            f"WHEN json_extract({v}, '$.match_score') IS NULL THEN 0 "
            f"ELSE TRY_CAST(json_extract_string({v}, '$.match_score') AS INTEGER) END)")


def relevant(js: str) -> str:
    v = valid(js)
    return (f"(CASE WHEN {is_obj(js)} THEN coalesce(TRY_CAST(json_extract({v}, '$.is_relevant') AS BOOLEAN), false) "
            f"ELSE false END)")


def field(js: str, key: str, default: str) -> str:
    """F7 (valid objects only; callers guard)."""
    return f"coalesce(json_extract_string({valid(js)}, '$.{key}'), {q(default)})"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def first_contained(text: str, patterns: list[str]) -> str:
    return "(CASE " + " ".join(f"WHEN contains({text}, {q(p)}) THEN {q(p)}" for p in patterns) + " END)"


def p5(loc: str) -> str:
    return first_contained(f"lower({loc})", rules.REJECTED_LOCATIONS)


def p6(company: str, title: str) -> str:
    c, t = f"lower({company})", f"lower({title})"
    return "(CASE " + " ".join(f"WHEN contains({c}, {q(p)}) OR contains({t}, {q(p)}) THEN {q(p)}"
                               for p in rules.OVERSEAS_COMPANY_PATTERNS) + " END)"


def p7(company: str) -> str:
    c = f"lower({company})"
    local = " OR ".join(f"contains({c}, {q(u)})" for u in rules.LOCAL_UNIVERSITIES)
    return f"((contains({c}, 'university') OR contains({c}, 'college')) AND NOT ({local}))"


def p9(title: str) -> str:
    t = f"lower({title})"
    hit = "(CASE " + " ".join(f"WHEN regexp_matches({t}, {q(chr(92) + 'b' + kw + chr(92) + 'b')}) THEN {q(kw)}"
                              for kw in rules.SENIORITY_KEYWORDS) + " END)"
    return f"(CASE WHEN NOT (contains({t}, 'student') OR contains({t}, 'intern')) THEN {hit} END)"


EXPERIENCE = "|".join(f"(?:{p})" for p in rules.EXPERIENCE_PATTERNS)


def p10(title: str, desc: str) -> str:
    return f"(regexp_matches(lower({title}), {q(EXPERIENCE)}) OR regexp_matches(lower({desc}), {q(EXPERIENCE)}))"


def p11(title: str, company: str, location: str, desc: str) -> str:
    t, c, loc, d = strip(title), strip(company), strip(location), strip(desc)
    return ("coalesce("
            f"CASE WHEN {p5(loc)} IS NOT NULL THEN 'Location ''' || {loc} || ''' matches rejected pattern ''' || {p5(loc)} || '''' END, "
            f"CASE WHEN {p6(c, t)} IS NOT NULL THEN 'Company/Title matches rejected overseas pattern ''' || {p6(c, t)} || '''' END, "
            f"CASE WHEN {p7(c)} THEN 'Non-Israeli university: ''' || {c} || '''' END, "
            f"CASE WHEN {p9(t)} IS NOT NULL THEN 'Title contains seniority keyword ''' || {p9(t)} || '''' END, "
            f"CASE WHEN {p10(t, d)} THEN {q(rules.EXPERIENCE_REASON)} END)")


def dumps_str(x: str) -> str:
    """A JSON string literal, character by character."""
    u = "'\\u' || format('{:04x}', %s)"
    return ("('\"' || array_to_string(list_transform(string_split(" + x + ", ''), lambda c: CASE WHEN c = '' THEN '' "
            "WHEN c = '\"' THEN '\\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' "
            "WHEN c = chr(9) THEN '\\t' WHEN c = chr(8) THEN '\\b' WHEN c = chr(12) THEN '\\f' "
            "WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN " + u % "unicode(c)"
            + " ELSE " + u % "55296 + ((unicode(c) - 65536) >> 10)" + " || " + u % "56320 + ((unicode(c) - 65536) & 1023)" + " END), '') || '\"')")


def py_text(js: str, key: str, default: str) -> str:
    """``str(json.get(key, default))`` for scalars and lists of scalars."""
    v = valid(js)
    at = f"json_extract({v}, '$.{key}')"
    # (a JSON null becomes NULL in the cast)
    item = ("coalesce(CASE json_type(x) WHEN 'VARCHAR' THEN chr(39) || json_extract_string(x, '$') || chr(39) WHEN 'NULL' THEN 'None' "
            "WHEN 'BOOLEAN' THEN upper(substr(CAST(x AS VARCHAR), 1, 1)) || substr(CAST(x AS VARCHAR), 2) ELSE CAST(x AS VARCHAR) END, 'None')")
    return (f"(CASE WHEN NOT {is_obj(js)} OR {at} IS NULL THEN {q(default)} WHEN json_type({at}) = 'NULL' THEN 'None' "
            f"WHEN json_type({at}) = 'ARRAY' THEN '[' || array_to_string(list_transform(CAST({at} AS JSON[]), lambda x: {item}), ', ') || ']' "
            f"ELSE json_extract_string({v}, '$.{key}') END)")


# evaluations in which some fields are lists or null
LISTED_SUMMARY = ("CASE WHEN id % 11 = 0 THEN replace(ai_summary, '\"key_features\": \"', "
                  "'\"key_features\": [\"Python\", \"SQL\", 3, null, true], \"kf\": \"') "
                  "WHEN id % 13 = 0 THEN replace(replace(ai_summary, '\"key_features\": \"', '\"key_features\": null, \"kf\": \"'), "
                  "'\"summary\": \"', '\"summary\": [], \"s\": \"') ELSE ai_summary END")
LISTED = f"listed AS (SELECT * REPLACE ({LISTED_SUMMARY} AS ai_summary) FROM jobs)"


def rejected_eval(reason: str, loc: str) -> str:
    return ("'{\"is_relevant\": false, \"match_score\": 0, \"summary\": ' || "
            f"{dumps_str(chr(39) + 'Rejected by pre-filter: ' + chr(39) + ' || ' + reason + ' || ' + chr(39) + '.' + chr(39))}"
            f" || ', \"location\": ' || {dumps_str('coalesce(' + loc + ', ' + q(rules.NOT_SPECIFIED) + ')')}"
            " || ', \"key_features\": \"N/A\", \"important_qualifications\": \"N/A\"}'")


def quote_plus(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def quote(x: str) -> str:
    return f"replace(url_encode({x}), '%2F', '/')"


def decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def canonical_url(source: str, url: str, out: str, strict: bool, keep: str = "*") -> str:
    """A SELECT over ``source`` adding column ``out`` = F1 (or F2 if strict)."""
    if strict:
        names = ", ".join(q(n.lower()) for n in rules.CRAWL_TRACKING_PARAMS)
        drop = f"len(list_filter([{names}], lambda n: starts_with(lower(p.k), n))) > 0"
    else:
        names = ", ".join(q(n) for n in rules.STORE_TRACKING_PARAMS)
        drop = f"list_contains([{names}], p.k)"
    s1 = (f"SELECT {keep}, lower(regexp_extract({url}, {q(URL_RE)}, 1)) AS _sch, "
          f"regexp_replace(regexp_extract({url}, {q(URL_RE)}, 2), '^//', '') AS _net, "
          f"regexp_replace(regexp_extract({url}, {q(URL_RE)}, 3), ';[^/]*$', '') AS _path, "
          f"regexp_extract({url}, {q(URL_RE)}, 4) AS _q, {url} AS _u FROM {source}")
    s2 = (f"SELECT *, list_filter(list_transform(list_filter(string_split(_q, '&'), "
          f"lambda x: instr(x, '=') > 0 AND length(x) > instr(x, '=')), "
          f"lambda x, i: {{'k': {decode('split_part(x, ' + chr(39) + '=' + chr(39) + ', 1)')}, "
          f"'v': {decode('substr(x, instr(x, ' + chr(39) + '=' + chr(39) + ') + 1)')}, 'pos': i}}), "
          f"lambda p: NOT ({drop})) AS _kept FROM ({s1}) _s1")
    s3 = (f"SELECT *, array_to_string(list_transform(list_sort(list_transform(_kept, lambda p: "
          f"{{'first': list_position(list_transform(_kept, lambda z: z.k), p.k), 'pos': p.pos, 'k': p.k, 'v': p.v}})), "
          f"lambda p: {quote_plus('p.k')} || '=' || {quote_plus('p.v')}), '&') AS _nq FROM ({s2}) _s2")
    body = ("CASE WHEN _net <> '' THEN '//' || _net || CASE WHEN _path = '' OR starts_with(_path, '/') THEN _path "
            "ELSE '/' || _path END WHEN _sch IN ('http', 'https', 'ftp', 'file', 'ws', 'wss', 'sftp', 'git', 'svn', 'ssh') "
            "AND starts_with(_path, '/') THEN '//' || _path ELSE _path END")
    value = (f"CASE WHEN _u IS NULL OR _u = '' THEN _u ELSE (CASE WHEN _sch <> '' THEN _sch || ':' ELSE '' END) || {body} "
             f"|| CASE WHEN _nq <> '' THEN '?' || _nq ELSE '' END END")
    return f"SELECT * EXCLUDE (_sch, _net, _path, _q, _u, _kept, _nq), {value} AS {out} FROM ({s3}) _s3"


LI_A = r'(?is)<li[^>]*>\s*<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def html_text(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


CARDS = ("cards AS (SELECT page_id, regexp_replace(regexp_extract(page_url, " + q(URL_RE) + ", 2), '^//', '') AS site, "
         "CAST(page_id AS STRING) AS query, CAST(i AS INTEGER) AS position, " + html_text("texts[i]") + " AS title, "
         "'Unknown' AS company, links[i] AS url, 'Israel' AS location, "
         "lower(regexp_extract(page_url, " + q(URL_RE) + ", 1)) || '://' || regexp_replace(regexp_extract(page_url, "
         + q(URL_RE) + ", 2), '^//', '') AS base_url "
         "FROM (SELECT page_id, url AS page_url, regexp_extract_all(html, " + q(LI_A) + ", 1) AS links, "
         "regexp_extract_all(html, " + q(LI_A) + ", 2) AS texts FROM pages) l, "
         "LATERAL (SELECT unnest(generate_series(1, len(l.links))) AS i) g)")


def keyword_classification(subject: str, body: str) -> dict:
    """SQL of the default classifier's four fields."""
    from postline.sources import mail
    t = f"lower(concat_ws(' ', {subject}, {body}))"

    def has(words):
        return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"

    declined = has(mail.DECLINE_WORDS)
    sub = "(CASE " + " ".join(f"WHEN {has(ws)} THEN {q(st)}" for st, ws in mail.SUB_STAGE_WORDS) + " END)"
    return {
        "is_relevant_update": f"({declined} OR {sub} IS NOT NULL)",
        "new_stage": f"(CASE WHEN {declined} THEN 'Declined' WHEN {sub} IS NOT NULL THEN 'In Process' END)",
        "new_sub_stage": f"(CASE WHEN NOT {declined} THEN {sub} END)",
        "reasoning": (f"(CASE WHEN {declined} THEN 'rejection wording' WHEN {sub} IS NOT NULL THEN 'mentions ' || lower({sub}) "
                      "ELSE 'no next step' END)"),
    }
