"""Property tests: native operators against small Python models.

Each hypothesis example is a whole list of inputs run as one Spark job,
so a handful of examples covers hundreds of cases.
"""

import re
from urllib.parse import parse_qsl, urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postline import rules
from postline.functions import urls
from postline.operators import dedup, filters

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


# ---------------------------------------------------------------------------
# F1 / F2: what a canonical URL must satisfy, and goldens
# ---------------------------------------------------------------------------
def store_drop(k):
    return k in rules.STORE_TRACKING_PARAMS


def crawl_drop(k):
    return any(k.lower().startswith(p.lower()) for p in rules.CRAWL_TRACKING_PARAMS)


KEYS = st.sampled_from(["q", "page", "ref", "trk", "utm_source", "role", "site", "Ref", "a", "b", "sortBy", "refId",
                        "currentJobId", "x", "עיר", "k%20y"])
VALUES = st.sampled_from(["1", "", "a b", "x+y", "%20z", "abc", "2", "Tel%20Aviv", "~t", "a/b", "תל אביב", "café",
                          "%D7%AA", "a=b", "*!'()"])


@st.composite
def url_strategy(draw):
    scheme = draw(st.sampled_from(["https", "http", "HTTPS"]))
    host = draw(st.sampled_from(["www.example.com", "Jobs.Example.org", "x.co.il"]))
    path = draw(st.sampled_from(["", "/", "/jobs/view/123", "/a/b;p=1", "/search"]))
    params = draw(st.lists(st.tuples(KEYS, VALUES, st.booleans()), max_size=6))
    query = "&".join(f"{k}={v}" if eq else k for k, v, eq in params)
    frag = draw(st.sampled_from(["", "#top", "#x=1"]))
    return f"{scheme}://{host}{path}" + (f"?{query}" if params else "") + frag


def pairs(url):
    return parse_qsl(urlparse(url).query)


@SETTINGS
@given(st.lists(url_strategy(), min_size=20, max_size=60))
def test_canonical_url_properties(spark, batch):
    """The pairs that are not dropped stay, nothing else does; the form is
    stable, and neither a fragment nor a dropped parameter, wherever it stands, changes it."""
    forms = ((urls.normalize_url, store_drop, "trk"), (urls.normalize_url_strict, crawl_drop, "refId"))
    for norm, drop, tracked in forms:
        rows = []
        for u in batch:
            base = u.partition("#")[0]
            head, mark, query = base.partition("?")
            rows.append((u, base, f"{head}?{tracked}=9" + (f"&{query}" if mark else ""), base + ("&" if mark else "?") + f"{tracked}=9"))
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string, bare string, front string, back string")
        got = df.select("i", *[norm(F.col(c)).alias(c) for c in ("u", "bare", "front", "back")], norm(norm(F.col("u"))).alias("again")).collect()
        for r in got:
            u, c = rows[r.i][0], r.u
            assert c == r.again == r.bare == r.front == r.back, u
            assert sorted(pairs(c)) == sorted((k, v) for k, v in pairs(u) if not drop(k)), u
            a, b = urlparse(u), urlparse(c)
            assert (a.scheme.lower(), a.netloc, a.path) == (b.scheme, b.netloc, b.path) and not b.fragment and not b.params, u
            keys = [k for k, _ in pairs(c)]
            assert [k for i, k in enumerate(keys) if k in keys[:i] and keys[i - 1] != k] == [], u       # repeated keys stand together


def test_canonical_url_goldens(spark):
    cases = {  # url: store form, crawl form
        "https://x.co.il/a?trk=1&q=a%20b&utm_source=z": ("https://x.co.il/a?q=a+b", "https://x.co.il/a?q=a+b"),
        "HTTPS://x.co.il/a;p=1?b=2&a=1&b=3#f": ("https://x.co.il/a?b=2&b=3&a=1", "https://x.co.il/a?b=2&b=3&a=1"),
        "https://x.co.il/?q=תל": ("https://x.co.il/?q=%D7%AA%D7%9C", "https://x.co.il/?q=%D7%AA%D7%9C"),
        "https://x.co.il/a?empty=&q": ("https://x.co.il/a", "https://x.co.il/a"),
        "https://x.co.il/plain/path": ("https://x.co.il/plain/path", "https://x.co.il/plain/path"),
        "": ("", ""),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: (r.a, r.b) for r in df.select("u", urls.normalize_url(F.col("u")).alias("a"), urls.normalize_url_strict(F.col("u")).alias("b")).collect()}
    assert got == cases


# ---------------------------------------------------------------------------
# P9 / P10 against Python's re
# ---------------------------------------------------------------------------
WORDS = st.sampled_from(["senior", "Sr", "sr.", "lead", "Lead", "student", "intern", "developer", "3+", "years",
                         "experience", "of", "2", "5", "-", "three", "vp", "head", "principal", "manager", "yrs", "10+"])


@SETTINGS
@given(st.lists(st.lists(WORDS, min_size=1, max_size=7).map(" ".join), min_size=20, max_size=60))
def test_rule_regexes_match_python(spark, titles):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    got = df.select("i", filters.senior_title(F.col("t")).alias("k"),
                    filters.requires_experience(F.col("t"), F.lit("")).alias("x")).collect()
    for r in got:
        t = titles[r.i].lower()
        exempt = "student" in t or "intern" in t
        want_k = None if exempt else next((k for k in rules.SENIORITY_KEYWORDS if re.search(rf"\b{k}\b", t)), None)
        want_x = any(re.search(p, t) for p in rules.EXPERIENCE_PATTERNS)
        assert (r.k, r.x) == (want_k, want_x), titles[r.i]


# ---------------------------------------------------------------------------
# A6 against the sequential loop
# ---------------------------------------------------------------------------
def admit_model(items):
    seen_u, seen_t, out = set(), set(), []
    for seq, u, t in sorted(items):
        tk = t.lower().strip()
        if u in seen_u or tk in seen_t:
            continue
        out.append(seq)
        seen_u |= {u} - {None}          # a missing URL or title equals nothing
        seen_t |= {tk} - {""}
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=5, max_size=80))
def test_admission_matches_sequential_loop(spark, pairs):
    items = [(i + 1, f"u{a}", f"t{b}") for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame([(s, u, t, "Co") for s, u, t in items], "seq long, url string, title string, company string")
    got = [r.seq for r in dedup.admit_batch(df).orderBy("seq").collect()]
    assert got == admit_model(items)


def test_admission_long_chain(spark):
    """A chain where every item blocks the next needs many rounds; the
    answer is still the sequential one (every other item)."""
    n = 24
    items = [(i + 1, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(n)]
    df = spark.createDataFrame([(s, u, t, "Co") for s, u, t in items], "seq long, url string, title string, company string")
    got = [r.seq for r in dedup.admit_batch(df).orderBy("seq").collect()]
    assert got == admit_model(items)


def test_admission_of_long_and_mixed_chains(spark):
    """A chain of 10,000 links takes under 20 rounds; chains that branch, and end at items that wait for several, equal the loop."""
    import random

    from postline.operators import dedup

    def got(items, **options):
        df = spark.createDataFrame([(s, u, t, "Co") for s, u, t in items], "seq long, url string, title string, company string")
        return [r.seq for r in dedup.admit_batch(df, **options).orderBy("seq").collect()]

    chain = [(i + 1, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(10_000)]
    assert got(chain, max_rounds=20) == admit_model(chain)
    r = random.Random(4)
    mixed = [(i + 1, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(60)]
    for k in range(60, 200):
        mixed.append((k + 1, f"u{r.randint(0, 90)}" if r.random() < .7 else None, f"t{r.randint(0, 90)}" if r.random() < .8 else ""))
    chain = [(200 + i + 1, f"v{(i + 1) // 2}", f"w{i // 2}") for i in range(40)] + [(300, "v0", "t5"), (301, "u9", "w20"), (302, "v19", "w19")]
    for items in (mixed, mixed + chain):
        assert got(items) == admit_model(items)


# ---------------------------------------------------------------------------
# J3 against the two-stage substring loop
# ---------------------------------------------------------------------------
NAME_WORDS = st.sampled_from(["acme", "ab", "x", "blue gear", "gear", "red ring", "ring", "io", "data co", "co",
                              "café", "é", "ünï corp", "😀"])
TEXT_WORDS = st.sampled_from(["acme", "gear", "hr", "x", "ring", "blue", "red", "io", "co", "data", "@", ".com", "-", " ",
                              "café", "é", "ünï", "corp", "😀", "\n", "漢字"])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(NAME_WORDS, min_size=1, max_size=6, unique=True),
       st.lists(st.tuples(st.lists(TEXT_WORDS, max_size=6).map("".join), st.lists(TEXT_WORDS, max_size=6).map("".join)),
                min_size=1, max_size=40))
def test_company_matching_rules(spark, companies, texts):
    from datetime import datetime, timedelta

    from postline.operators import joins
    t0 = datetime(2024, 1, 1)
    # active order: To Apply newest first -> list order via decreasing dates
    jobs = spark.createDataFrame([(i + 1, c, "To Apply", t0 - timedelta(days=i)) for i, c in enumerate(companies)],
                                 "id long, company string, stage string, date_found timestamp")
    msgs = [(i + 1, s, j) for i, (s, j) in enumerate(texts)]
    mdf = spark.createDataFrame(msgs, "seq long, sender string, subject string")
    got = {r.seq: (r.company_key, r.tier) for r in joins.match_company(mdf, joins.company_index(jobs)).collect()}
    by_grams = joins.match_company(mdf, joins.company_index(jobs), max_needles=0)
    assert {r.seq: (r.company_key, r.tier) for r in by_grams.collect()} == got

    def part_in(c, text):
        return any(len(p) > 2 and p in text for p in c.split(" "))

    for seq, sender, subject in msgs:
        s, j = sender.lower(), subject.lower()
        whole = [c for c in companies if c in s or c in j]
        parts = [c for c in companies if part_in(c, s)]
        if seq not in got:
            assert not whole and not parts
        elif got[seq][1] == 1:      # a whole name goes first, and of several the first in active order
            assert got[seq][0] == min(whole, key=companies.index)
        else:
            assert not whole and got[seq][0] == min(parts, key=companies.index)


def test_company_matching_long_text_carries_no_text(spark):
    """A long message: the plan carries slices as long as the longest name, not the text."""
    from datetime import datetime

    from postline.operators import joins
    jobs = spark.createDataFrame([(1, "blue gear", "To Apply", datetime(2024, 1, 1))], "id long, company string, stage string, date_found timestamp")
    long = "filler é " * 20_000
    mdf = spark.createDataFrame([(1, "hr@x", long + "Blue Gear"), (2, "hr@x", long)], "seq long, sender string, subject string")
    companies = joins.company_index(jobs)
    want = [(1, "blue gear", 1)]
    plans = []
    for bound in (joins.MAX_NEEDLES, 0):
        out = joins.match_company(mdf, companies, max_needles=bound)
        assert [(r.seq, r.company_key, r.tier) for r in out.collect()] == want
        plans.append([line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line])
    assert not plans[0]                               # the messages are matched where they are
    assert plans[1] and not any("_chars" in line or ("_slice" in line and "text" in line) for line in plans[1])


def test_company_matching_without_companies(spark):
    from postline.operators import joins
    mdf = spark.createDataFrame([(1, "hr@x", None), (2, None, "none")], "seq long, sender string, subject string")
    none = spark.createDataFrame([], "company_key string, company_ord struct<b:int,d:long,id:long>, n_jobs long")
    one = spark.createDataFrame([("none", (0, None, 1), 1)], none.schema)
    for bound in (joins.MAX_NEEDLES, 0):
        assert joins.match_company(mdf, none, max_needles=bound).collect() == []
        # a missing header reads as 'none'
        assert sorted(r.seq for r in joins.match_company(mdf, one, max_needles=bound).collect()) == [1, 2]


def test_admission_oracle_sql_matches_loop():
    """The recursive-CTE oracle of A6 (DuckDB) agrees with the sequential
    loop on random batches and on a long chain."""
    import random

    import duckdb

    from postline.plans.registry import A6_SQL
    body = A6_SQL[A6_SQL.index(", items AS"):]
    con = duckdb.connect()

    def run(items):
        vals = ", ".join(f"({s}, '{u}', '{t}', 'Co')" for s, u, t in items)
        q = f"WITH RECURSIVE arrivals AS (SELECT * FROM (VALUES {vals}) v(seq, url, title, company))" + body
        return sorted(r[0] for r in con.execute(q).fetchall())
    rnd = random.Random(11)
    for _ in range(100):
        n, a, b = rnd.randint(1, 50), rnd.randint(1, 10), rnd.randint(1, 10)
        items = [(i + 1, f"u{rnd.randint(0, a)}", f"t{rnd.randint(0, b)}") for i in range(n)]
        assert run(items) == admit_model(items), items
    chain = [(i + 1, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(40)]
    assert run(chain) == admit_model(chain)
