"""Golden rows (FIXTURES.md section A and C) through the operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from postline.functions import evaluation as ev
from postline.functions import urls
from postline.operators import dedup, filters, joins, reports, state
from postline.sources.mail import mail_provider


def _one_col(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_normalize_url_goldens(spark):
    cases = {
        "https://www.linkedin.com/jobs/view/123?trk=abc&ref=def&utm_source=email": "https://www.linkedin.com/jobs/view/123",
        "": "",
        "https://www.example.com/jobs/123": "https://www.example.com/jobs/123",
        "https://a.com/x;p=1?b=&c=1&c=2&ref=z#f": "https://a.com/x?c=1&c=2",
        "HTTPS://A.com/x?q=a b": "https://A.com/x?q=a+b",
        "https://a.com/?": "https://a.com/",
        "https://a.com/p?a=1&b=&a=2&c=%20x+y&d": "https://a.com/p?a=1&a=2&c=+x+y",
    }
    df = _one_col(spark, list(cases))
    got = dict(df.select("v", urls.normalize_url(F.col("v")).alias("n")).collect())
    assert got == cases
    a = "https://x.com/j/123?trk=abc&ref=def"
    b = "https://x.com/j/123?ref=def&trk=abc"
    out = _one_col(spark, [a, b]).select(urls.normalize_url(F.col("v")).alias("n")).collect()
    assert out[0].n == out[1].n


def test_strict_url_over_strips(spark):
    url = "https://x.com/s?role=a&size=b&site=c&reference=d&rooms=e&sourceId=f&page=2"
    got = _one_col(spark, [url]).select(urls.normalize_url_strict(F.col("v")).alias("n")).first().n
    assert got == "https://x.com/s?page=2"


def test_score_parsing_goldens(spark):
    cases = [
        ('{"match_score": 85}', 85, 85), ('{"match_score": "85"}', 85, 85), ('{"match_score": 85.7}', 85, 85),
        ('{"match_score": "85.7"}', 0, None), ('{"match_score": null}', 0, None), ('{"match_score": true}', 1, 1),
        ('{"is_relevant": "false"}', 0, 0), ("not json", 0, None), ("[1]", 0, None), ("", 0, None),
        ('{"match_score":1,"match_score":2}', 2, 2),          # the last repeated key wins, as in Python
    ]
    df = _one_col(spark, [c[0] for c in cases])
    got = {r.v: (r.s, r.n) for r in df.select("v", ev.parse_score(F.col("v")).alias("s"),
                                              ev.parse_score_or_null(F.col("v")).alias("n")).collect()}
    for text, score, nullable in cases:
        assert got[text] == (score, nullable), text


def test_seniority_goldens(spark):
    yes = ["Sr Developer", "srx", "sr.developer", "Senior Dev", "Vp", "Head of R&D"]
    no = ["Sr. Developer", "Leading dev", "Team Lead Student", "International Sales Manager"]
    df = _one_col(spark, yes + no)
    got = dict(df.select("v", filters.senior_title(F.col("v")).alias("k")).collect())
    assert all(got[t] is not None for t in yes), got
    assert all(got[t] is None for t in no), got


def test_experience_goldens(spark):
    yes = ["3+ years", "10+ yrs", "1-3 years experience", "3-5 years", "three years of experience", "00+ years",
           "13 years experience", "3 years experience"]
    no = ["2+ years", "2 years", "3 years of relevant experience", "113 years experience", "é3+ years"]
    df = _one_col(spark, yes + no)
    got = dict(df.select("v", filters.requires_experience(F.lit(""), F.col("v")).alias("x")).collect())
    assert [t for t in yes if not got[t]] == []
    assert [t for t in no if got[t]] == []


def test_location_list_order(spark):
    df = _one_col(spark, ["new york, usa", "tel aviv", "jerusalem"])
    got = dict(df.select("v", filters.location_rejected(F.col("v")).alias("p")).collect())
    assert got == {"new york, usa": "usa", "tel aviv": None, "jerusalem": "usa"}


def test_dedup_survivor(spark):
    def js(s):
        return '{"is_relevant": true, "match_score": %d}' % s
    data = [(1, "Irrelevant", 99), (2, "To Apply", 70), (3, "To Apply", 80), (4, "To Apply", 80), (5, "In Process", 95)]
    df = spark.createDataFrame([(i, "Dev ", " Acme", st, js(s)) for i, st, s in data],
                               "id long, title string, company string, stage string, ai_summary string")
    kept = dedup.dedup_postings(df)
    assert rows(kept, "id") == [(3,)]
    assert rows(dedup.dedup_losers(df, kept), "id") == [(1,), (2,), (4,), (5,)]
    assert dedup.dedup_removed_count(df).first().removed == 4


def test_admission_goldens(spark):
    for batch, admitted in [
        ([(1, "u1", "t1"), (2, "u2", "t1"), (3, "u2", "t3")], [1, 3]),
        ([(1, "u1", "t1"), (2, "u1", "t2"), (3, "u3", "t2")], [1, 3]),
    ]:
        df = spark.createDataFrame([(s, u, t, "Co") for s, u, t in batch], "seq long, url string, title string, company string")
        assert [r.seq for r in dedup.admit_batch(df).orderBy("seq").collect()] == admitted


def test_relevance_routing_and_demotion(spark):
    cases = [('{"is_relevant": true, "match_score": 70}', "To Apply", False),
             ('{"is_relevant": true, "match_score": 69}', "Irrelevant", False),
             ('{"is_relevant": false, "match_score": 90}', "Irrelevant", False),
             ('{"is_relevant": false, "match_score": 69}', "Irrelevant", True),
             ("garbage", "Irrelevant", False)]
    df = spark.createDataFrame([(i, c[0], "To Apply") for i, c in enumerate(cases)], "id long, ai_summary string, stage string")
    js = F.col("ai_summary")
    routed = df.select("id", ev.route_by_score(ev.is_relevant(js), ev.parse_score(js)).alias("r"))
    assert [r.r for r in routed.orderBy("id").collect()] == [c[1] for c in cases]
    demoted = filters.demote_low_scores(df).orderBy("id").collect()
    assert [r.demoted for r in demoted] == [c[2] for c in cases]


def test_company_matching_goldens(spark):
    t0 = datetime(2024, 1, 2)
    jobs = spark.createDataFrame([(1, "Blue Gear", "To Apply", t0), (2, "Acme", "To Apply", t0 - timedelta(days=1))],
                                 "id long, company string, stage string, date_found timestamp")
    msgs = spark.createDataFrame([(1, "hr@acme.com", "hello"), (2, "gear@x.com", "hi"), (3, "a@b.com", "gear"),
                                  (4, "acme", "blue gear")], "seq long, sender string, subject string")
    got = dict((r.seq, (r.company_key, r.tier)) for r in joins.match_company(msgs, joins.company_index(jobs)).collect())
    assert got == {1: ("acme", 1), 2: ("blue gear", 2), 4: ("blue gear", 1)}


def test_health_labels(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 4, 0.4), ("c", 5, 0.9), ("d", 15, 0.99)],
                               "site string, f long, r double")
    got = dict(df.select("site", reports.health_label(F.col("f"), F.col("r")).alias("h")).collect())
    assert got == {"a": "healthy", "b": "degraded", "c": "failing", "d": "circuit_open"}


def test_score_tiers(spark):
    df = spark.createDataFrame([(s,) for s in [69, 70, 84, 85, 94, 95, 100]], "score int")
    r = reports.score_tiers(df).first()
    assert (r.tier_95, r.tier_85, r.tier_70) == (2, 2, 2)


def test_breaker_sequences(spark):
    t = datetime(2024, 1, 1)

    def state(outcomes, threshold, recovery, now):
        df = spark.createDataFrame([(i, "s", t + timedelta(seconds=i), ok) for i, ok in enumerate(outcomes)],
                                   "id long, site string, ts timestamp, success boolean")
        return reports.breaker_state(df, F.lit(now), threshold, recovery).first().is_open
    assert state([False, False], 2, 300, t + timedelta(seconds=2)) is True
    assert state([False, True], 2, 300, t + timedelta(seconds=2)) is False
    assert state([False], 1, 2, t + timedelta(seconds=0.1)) is True
    assert state([False], 1, 2, t + timedelta(seconds=2.2)) is False
    assert state([False] * 3, 5, 1800, t + timedelta(seconds=3)) is False
    assert state([False] * 6, 5, 1800, t + timedelta(seconds=6)) is True
    # a check after the recovery window closes the breaker and resets its count
    df = spark.createDataFrame([(0, "s", t, False)], "id long, site string, ts timestamp, success boolean")
    r = reports.breaker_state(df, F.lit(t + timedelta(seconds=2.2)), 1, 2).first()
    assert (r.is_open, r.trailing_failures) == (False, 0)


def test_mail_provider(spark):
    df = _one_col(spark, ["user@gmail.com", "user@outlook.com", "x@acme.com"])
    got = {r.v: (r.p.provider, r.p.host) for r in df.select("v", mail_provider(F.col("v")).alias("p")).collect()}
    assert got["user@gmail.com"] == ("gmail", "imap.gmail.com")
    assert got["user@outlook.com"] == ("outlook", "outlook.office365.com")
    assert got["x@acme.com"][0] == "icloud"            # 'me.com' is a substring of the domain


def test_format_field(spark):
    cases = {'["a","","b"]': "- a\n- b", '{"items":["x"]}': "- x", '{"tech_stack":"py"}': "- **Tech Stack:** py",
             "[a, b]": "- a\n- b", "plain": "plain", "123": None, "": ""}
    df = _one_col(spark, list(cases))
    got = dict(df.select("v", ev.format_field(F.col("v")).alias("f")).collect())
    assert got == cases


def test_format_field_literals_and_order(spark):
    cases = {"['a', None, 'b c']": "- a\n- b c", "{'z_key': 'x', 'a': ['p', 2]}": "- **Z Key:** x\n- **A:** ['p', 2]",
             '{"z": 1, "a": true, "m": {"q": "r"}, "e": []}': "- **Z:** 1\n- **A:** True\n- **M:** {'q': 'r'}",
             '{"x": "y", "list": ["l"], "items": ["i"]}': "- i", "True": None, "None": "", "null": "", "[]": "", "0": "", "(1, 2)": None, "  ": "",
             '"quoted"': "quoted", '"[1, 2]"': "- 1\n- 2", "[broken": "[broken", "-dash text": "-dash text", " as it is ": " as it is ", "['x', 'it\\'s']": "- x\n- it's"}
    df = _one_col(spark, [*cases, None])
    got = dict(df.select("v", ev.format_field(F.col("v")).alias("f")).collect())
    assert got == cases | {None: None}


def test_json_strings_parse_and_equal_dumps(spark):
    import json
    texts = ['a"b\\c', "tab\tnl\nret\rbell\x07 del\x7f nul\x00", "תל אביב", "é😀", "", "plain ascii ~ !"]
    df = _one_col(spark, texts)
    got = {r.v: (r.j, r.e) for r in df.select("v", ev.json_string(F.col("v")).alias("j"), ev.rejected_evaluation(F.col("v"), F.col("v")).alias("e")).collect()}
    for t in texts:
        assert got[t][0] == json.dumps(t)
        assert json.loads(got[t][1])["location"] == t


def test_rendered_fields_print_as_python_does(spark):
    import json
    values = [["Python", "SQL"], ["it's", 'a "b"', 3, None, True, 1.5], None, "text", 7, False, [], {"k": "v", "n": [1]}]
    df = spark.createDataFrame([(i, json.dumps({"f": v})) for i, v in enumerate(values)] + [(98, "{}"), (99, "no json")], "i int, js string")
    got = {r.i: (r.t, r.b) for r in df.select("i", ev.json_text(F.col("js"), "f", "dflt").alias("t"), ev.json_truthy(F.col("js"), "f").alias("b")).collect()}
    for i, v in enumerate(values[:7]):
        assert got[i] == (str(v), bool(v))
    assert got[7] == ("{'k': 'v', 'n': [1]}", True) and got[98] == got[99] == ("dflt", False)


def test_append_leaves_out_what_the_table_forbids(spark):
    store = spark.createDataFrame([(4, "A", "Co", "https://x/1")], "id long, title string, company string, url string")
    rows_ = [(1, None, "c", "https://x/2"), (2, "t", None, "https://x/3"), (3, "t", "c", None), (4, "u", "c", None), (5, "ok", "c", "https://x/4")]
    batch = spark.createDataFrame([(*r, None, None, None) for r in rows_],
                                  "seq long, title string, company string, url string, ai_summary string, stage string, location string")
    got = state.append_new(store, batch, F.lit("2024-01-01").cast("timestamp")).select("id", "title").collect()
    assert [tuple(r) for r in got] == [(5, "ok")]


def test_priorities_reader_and_prompt(spark, tmp_path):
    from postline import rules
    path = tmp_path / "priorities.txt"
    path.write_text("first: student\r\n\nsecond: no experience\n")
    frame = rules.priorities_frame(spark, str(path))
    assert [tuple(r) for r in frame.orderBy("ordinal").collect()] == [(1, "first: student"), (3, "second: no experience")]
    prompt = rules.system_prompt(frame, "a profile").first().prompt
    assert "a profile" in prompt and "first: student\nsecond: no experience" in prompt


def test_whole_bodies_are_classified(spark):
    from postline.plans import scoring
    df = spark.createDataFrame([(1, "s", "x " * 3000 + "unfortunately", "c")], "seq long, subject string, body string, company_key string")
    assert scoring.classify_messages(df).first().classification.new_stage == "Declined"
    seen = scoring.classify_messages(df, lambda s, b, c: {"is_relevant_update": True, "new_stage": str(len(b)), "new_sub_stage": None}, body_limit=2000)
    assert seen.first().classification.new_stage == "2000"


def test_a_cluster_needs_a_shared_checkpoint_folder(spark, monkeypatch):
    from postline import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Fake:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Fake())


def test_quirk_options(spark):
    df = _one_col(spark, ["Sr. Developer", "srx", "ÉCOLE "])
    r = {x.v: x for x in df.select("v", filters.senior_title(F.col("v"), escape=True).alias("k"),
                                   dedup.norm_key(F.col("v"), ascii_only=True).alias("a"),
                                   dedup.norm_key(F.col("v")).alias("u")).collect()}
    assert r["Sr. Developer"].k == "sr." and r["srx"].k is None
    assert (r["ÉCOLE "].a, r["ÉCOLE "].u) == ("École", "école")
    m = _one_col(spark, ["x@acme.com", "y@me.com", "z@olive.com"])
    got = {x.v: x.p.provider for x in m.select("v", mail_provider(F.col("v"), exact_domain=True).alias("p")).collect()}
    assert got == {"x@acme.com": "gmail", "y@me.com": "icloud", "z@olive.com": "gmail"}


def test_empty_url_option(spark):
    store = spark.createDataFrame([(1, "A", "Co", "")], "id long, title string, company string, url string")
    batch = spark.createDataFrame([(2, "B", "Co", "")], "id long, title string, company string, url string")
    assert joins.drop_seen(batch, store).count() == 0                       # '' equals the stored ''
    assert joins.drop_seen(batch, store, empty_url_fallback=True).count() == 1


def test_invalid_classifier_output_is_not_applied(spark):
    from postline.plans import cycle
    t0 = datetime(2024, 1, 2)
    jobs = spark.createDataFrame([(1, "acme", "To Apply", t0, None)],
                                 "id long, company string, stage string, date_found timestamp, sub_stage string")
    msgs = spark.createDataFrame([(1, "hr@acme.com", "s", "b"), (2, "hr@acme.com", "s", "b")],
                                 "seq long, sender string, subject string, body string")

    def classifier(subject, body, company):
        return {"is_relevant_update": True, "new_stage": "Applied", "new_sub_stage": None}

    def bad(subject, body, company):
        return '{"is_relevant_update": true, "new_stage": "Hired!!", "new_sub_stage": null}'
    assert [(r.id, r.new_stage) for r in cycle.mail_updates(msgs, jobs, classifier).collect()] == [(1, "Applied")]
    assert cycle.mail_updates(msgs, jobs, bad).count() == 0


def test_user_scorer_runs_once_per_posting(spark):
    from postline.plans import scoring
    posts = spark.createDataFrame([(1, "Student Dev", "Acme", "Haifa", "x"), (2, "Dev", "Beta", "Haifa", "y")],
                                  "id long, title string, company string, location string, description string")

    def scorer(p):
        return {"is_relevant": p["title"].startswith("Student"), "match_score": 96 if p["title"].startswith("Student") else 10,
                "summary": "s", "location": p["location"], "key_features": "", "important_qualifications": ""}
    out = {r.id: (r.evaluation.is_relevant, r.evaluation.match_score)
           for r in scoring.score_postings(posts, scorer).collect()}
    assert out == {1: (True, 96), 2: (False, 10)}
    bounded = scoring.score_postings(posts, scorer, max_concurrency=2)
    assert bounded.rdd.getNumPartitions() == 2 and bounded.count() == 2
    built = scoring.score_postings(posts, scorer_factory=lambda: scorer, max_concurrency=1)
    assert {r.id: r.evaluation.match_score for r in built.collect()} == {1: 96, 2: 10}


def test_rfc822_parsing(spark):
    from postline.sources.mail import parse_messages
    multipart = (b"From: hr@acme.com\r\nSubject: =?utf-8?b?w4lxdWlwZQ==?= =?iso-8859-1?q?_two?=\r\nMIME-Version: 1.0\r\n"
                 b"Content-Type: multipart/alternative; boundary=XX\r\n\r\n--XX\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"
                 b"part one\r\n--XX\r\nContent-Type: text/html\r\n\r\n<p>html</p>\r\n--XX\r\nContent-Type: text/plain\r\n\r\n"
                 b"part two\r\n--XX--\r\n")
    single_html = b"From: a@b.com\r\nSubject: plain\r\nContent-Type: text/html\r\n\r\n<b>hi</b>"
    no_subject = b"From: a@b.com\r\n\r\nbody"
    raw = spark.createDataFrame([(1, bytearray(multipart)), (2, bytearray(single_html)), (3, bytearray(no_subject))],
                                "seq long, content binary")
    got = {r.seq: r for r in parse_messages(raw).collect()}
    assert got[1].subject == "Équipe" and got[1].body == "part onepart two"
    assert (got[2].subject, got[2].body) == ("plain", "<b>hi</b>")
    assert got[3].error is not None and got[3].subject is None


def test_single_part_messages_read_like_the_standard_parser():
    """Well-formed heads are read without the line-by-line parser, to the same message; others are left to it."""
    import email
    from postline.sources import mail
    subject = b"Subject: =?utf-8?b?w4lxdWlwZQ==?=\r\n two\r\n"
    plain = [b"From: a@b.com\r\n" + subject + b"\r\nbody\rof\n\r\ncaf\xc3\xa9", b"from:a@b.com\nSubject:\n\tfolded \r\n\n", b"X: 1\r\n\r\nno subject",
             subject + b"From: \xc3\xa9 <a@b.com>\n\nx", b"Subject: \xe9\n\nx", b"Subject: a\nSubject: b\n\nSubject: c\n\nx",
             *[b"Subject: s\r\nContent-Type: " + t + b"\r\nContent-Transfer-Encoding: " + e + b"\r\n\r\naGVsbG8=\r\n\xe9=20\r\n"
               for t in (b"text/html; charset=latin-1", b"text/plain;\r\n charset=nope", b"image/png") for e in (b"base64", b"quoted-printable", b"8bit")]]
    other = [b"", b"\r\nbody", b"Subject: no empty line", b" folded\r\nSubject: s\r\n\r\nx", b"From a@b.com\r\nSubject: s\r\n\r\nx", b"Subject: a\rTo: b\n\nx",
             b"Subject: s\r\nno header\r\n\r\nx", b": v\r\n\r\nx", b"Subject: a\x0cb\r\n\r\nx", b"Subject: s\r\nContent-Type: multipart/mixed; boundary=X\r\n\r\n--X\r\n\r\np\r\n--X--",
             b"Subject: s\r\nContent-Type: message/rfc822\r\n\r\nSubject: t\r\n\r\nx"]

    def read(msg):
        def tried(f):
            try:
                return f(msg)
            except Exception as e:
                return f"{type(e).__name__}: {e}"
        return [(k, str(v)) for k, v in msg.items()], str(msg.get("From")), tried(mail._subject), mail._body(msg), msg.get_payload(decode=True), msg.get_content_type()

    for content in plain:
        assert read(mail._single_part(content)) == read(email.message_from_bytes(content))
    assert [mail._single_part(c) for c in other] == [None] * len(other)


def test_parsed_messages_keep_large_keys_beside_null_ones(spark):
    from postline.sources.mail import parse_messages
    content = bytearray(b"From: a@b.com\r\nSubject: s\r\n\r\nx")
    raw = spark.createDataFrame([(2**53 + 1, content), (None, content), (3, None)], "seq long, content binary").coalesce(1)
    got = sorted((r.seq or 0, r.subject, r.error is None) for r in parse_messages(raw).collect())
    assert got == [(0, "s", True), (3, None, False), (2**53 + 1, "s", True)]


def test_recheck_prior_reason_option(spark):
    from postline.plans import cycle
    stored = ev.rejected_evaluation(F.lit("Requires prior professional experience (3+ years)"), F.lit("Tel Aviv"))
    jobs = spark.createDataFrame([(1, "Student Developer", "Acme", "u", "Irrelevant")],
                                 "id long, title string, company string, url string, stage string") \
        .withColumn("ai_summary", stored)
    assert cycle.recheck(jobs).first().stage == "Irrelevant"                          # Q10: rejected again
    assert cycle.recheck(jobs, strip_prior_reason=True).first().stage == "To Apply"


def test_word_boundary_option(spark):
    locs = ["jerusalem", "new york, usa", "milwaukee", "london, uk", "caesarea", "Austin, CA", "indiana"]
    df = _one_col(spark, locs)
    got = {r.v: (r.sub, r.word) for r in df.select("v", filters.location_rejected(F.col("v")).alias("sub"),
                                                   filters.location_rejected(F.col("v"), word_boundary=True).alias("word"))
           .collect()}
    assert got["jerusalem"] == ("usa", None)
    assert got["new york, usa"][1] is not None and got["london, uk"][1] is not None
    assert got["milwaukee"][1] is None and got["caesarea"][1] is None
    assert got["Austin, CA"][1] is not None


def test_strict_relevance_and_success_time(spark):
    df = _one_col(spark, ['{"is_relevant": "false", "match_score": 80}', '{"is_relevant": true, "match_score": 80}'])
    got = [(r.a.is_relevant, r.b.is_relevant) for r in df.orderBy("i").select(
        ev.coerce_evaluation(F.col("v")).alias("a"), ev.coerce_evaluation(F.col("v"), strict=True).alias("b")).collect()]
    assert got == [(True, False), (True, True)]
    t = datetime(2024, 1, 1)
    att = spark.createDataFrame([(1, "s", t, True, 3, 100.0, None), (2, "s", t + timedelta(seconds=1), False, 0, 50.0, "x")],
                                "id long, site string, ts timestamp, success boolean, jobs_found int, "
                                "response_time_ms double, error string")
    m = reports.site_metrics(att).first()
    assert (m.avg_response_ms, m.avg_success_ms) == (50.0, 100.0)


def test_empty_inputs(spark):
    from postline.plans import cycle
    from postline.sources import tables as tb
    from conftest import SF_SMALL
    store, batch = tb.store_and_batch(spark, SF_SMALL)
    none = batch.select(F.col("id").alias("seq"), "title", "company", "url", "location",
                        F.col("title").alias("description")).limit(0)
    out = cycle.run_cycle(store, none, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    assert out["summary"].first().total_scanned == 0 and out["summary"].first().new_matches == 0
    assert out["store"].count() > 0 and "Top Picks" not in out["message"].first()[0]
    msgs = spark.createDataFrame([], "seq long, sender string, subject string, body string")
    assert cycle.mail_updates(msgs, tb.mail_jobs(spark, SF_SMALL)).count() == 0
    att = spark.createDataFrame([], "id long, site string, ts timestamp, success boolean, jobs_found int, "
                                    "response_time_ms double, error string")
    assert reports.site_metrics(att).count() == 0 and dedup.failure_runs(att).count() == 0
    assert reports.global_positions(att, ["site"], [F.col("ts")]).count() == 0


def test_matcher_reads_headers_like_python(spark):
    t0 = datetime(2024, 1, 2)
    jobs = spark.createDataFrame([(1, " Acme\t", "To Apply", t0), (2, "One", "In Process", t0)],
                                 "id long, company string, stage string, date_found timestamp")
    msgs = spark.createDataFrame([(1, "hr@acme.com", "x"), (2, None, "hello")], "seq long, sender string, subject string")
    idx = joins.company_index(jobs)
    assert sorted(r.company_key for r in idx.collect()) == ["acme", "one"]      # Python strip: the tab goes too
    got = {r.seq: r.company_key for r in joins.match_company(msgs, idx).collect()}
    assert got == {1: "acme", 2: "one"}                                          # a missing sender reads 'none'


def test_ingest_admits_on_canonical_urls(spark):
    from postline.plans import cycle
    store = spark.createDataFrame([(1, "Old", "Co", "https://x.com/j/1", None, "To Apply", None, "Tel Aviv", datetime(2024, 1, 1))],
                                  "id long, title string, company string, url string, ai_summary string, stage string, "
                                  "sub_stage string, location string, date_found timestamp")
    posts = spark.createDataFrame([(1, "Student Dev", "Acme", "https://x.com/j/2?trk=a", "Tel Aviv", "student"),
                                   (2, "Student QA", "Beta", "https://x.com/j/2?utm_source=b", "Tel Aviv", "student")],
                                  "seq long, title string, company string, url string, location string, description string")
    ins = cycle.ingest(store, posts, F.lit(datetime(2024, 6, 1)))["inserted"].collect()
    assert [(r.title, r.url) for r in ins] == [("Student Dev", "https://x.com/j/2")]


def test_recheck_skips_non_text_location(spark):
    from postline.plans import cycle
    jobs = spark.createDataFrame([(1, "Student Dev", "Acme", "u1", "To Apply", '{"location": null, "summary": "s"}'),
                                  (2, "Student Dev", "Beta", "u2", "To Apply", '{"location": 5}'),
                                  (3, "Student Dev", "Gamma", "u3", "To Apply", '{"summary": "no location key"}'),
                                  (4, "Student Dev", "Delta", "u4", "To Apply", "not json")],
                                 "id long, title string, company string, url string, stage string, ai_summary string")
    assert sorted(r.id for r in cycle.recheck(jobs).collect()) == [3, 4]
