"""Board-profile card extraction (S3) and the clean-up chain
(A3 -> P3 -> P2 -> F2 -> P4) on small hand-written pages."""

from pyspark.sql import functions as F

from postline.plans import registry
from postline.sources import html

LINKEDIN = """<html><body><ul>
<li><div class="base-card">
  <h3 class="base-search-card__title"> Junior Data Analyst </h3>
  <h4 class="base-search-card__subtitle">Acme</h4>
  <a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/1?trk=x&amp;refId=y">open</a>
  <div class="base-search-card__metadata"><span>x</span><span>Tel Aviv</span></div>
</div></li>
<li><div class="base-card"><h3><a href="/jobs/view/2">Student Developer</a></h3></div></li>
<li><div class="base-card"><h4 class="base-search-card__subtitle">No Title Inc</h4></div></li>
</ul></body></html>"""

JOBMASTER = """<div class="JobItem"><a href="/jobs/checknum.asp?key=7">Python Student</a>
<span class="jobLocation">Haifa</span></div>
<div class="JobItem"><a>no link</a></div>
<div class="job-item"><div class="CardHeader"><a href="jobs/8">QA Junior</a></div><div>Beta Ltd</div></div>"""

INDEED = """<div class="job_seen_beacon"><h2 class="jobTitle"><a href="/rc/clk?jk=1"><span>Data Engineer Junior</span></a></h2>
<span data-testid="company-name">Gamma</span><div data-testid="text-location">Ramat Gan</div></div>"""


def test_board_profiles(spark):
    pages = spark.createDataFrame([(1, "linkedin", "q", LINKEDIN), (2, "jobmaster", "q", JOBMASTER),
                                   (3, "indeed", "q", INDEED)], "page_id long, site string, query string, html string")
    cards = {(r.page_id, r.position): r for r in html.extract_cards(pages).collect()}
    li1 = cards[(1, 1)]
    assert (li1.title, li1.company, li1.location) == ("Junior Data Analyst", "Acme", "Tel Aviv")
    li2 = cards[(1, 2)]
    assert (li2.title, li2.company, li2.url, li2.location) == ("Student Developer", "Unknown", "/jobs/view/2", "Israel")
    assert (1, 3) not in cards                                    # no title node: not a card
    jm1 = cards[(2, 1)]
    assert (jm1.title, jm1.location) == ("Python Student", "Haifa")  # title from the first link
    assert (2, 2) in cards and cards[(2, 2)].title == "QA Junior"    # link without href is no title
    assert cards[(2, 2)].company == "Beta Ltd"
    ind = cards[(3, 1)]
    assert (ind.title, ind.company, ind.location, ind.url) == ("Data Engineer Junior", "Gamma", "Ramat Gan", "/rc/clk?jk=1")

    clean = {(r.page_id, r.position): r for r in html.clean_postings(html.extract_cards(pages)).collect()}
    assert clean[(1, 1)].url == "https://www.linkedin.com/jobs/view/1"           # both params are crawl-tracking
    assert clean[(1, 2)].url == "https://www.linkedin.com/jobs/view/2"           # absolutised
    assert clean[(1, 1)].description == "Linkedin Job: Junior Data Analyst @ Acme"
    assert clean[(3, 1)].url == "https://www.indeed.com/rc/clk?jk=1"             # path is not a parameter


def test_cap_applies_before_title_filter(spark):
    items = "".join(f'<li><a href="/j/{i}">{"" if i % 2 else "Job " + str(i)}</a></li>' for i in range(1, 9))
    pages = spark.createDataFrame([(1, "https://b.example.com/list", f"<ul>{items}</ul>")], "page_id long, url string, html string")
    kept = html.clean_postings(html.extract_list_cards(pages), cap=4).orderBy("position").collect()
    assert [r.title for r in kept] == ["Job 2", "Job 4"]
    assert kept[0].url == "https://b.example.com/j/2"


def test_deep_and_sloppy_pages(spark):
    deep = "<div>" * 3000 + '<div class="base-card"><h3 class="base-search-card__title">Deep</h3></div>' + "</div>" * 3000
    item = "<li><div class='job_seen_beacon'><h2><a href='/{0}'><span>Job {0}</span></a></h2>"
    rows = [(1, "linkedin", "q", deep), (2, "indeed", "q", "<ul>" + item.format(1) + item.format(2) + "</ul>"), (3, "nowhere", "q", "x"), (4, "indeed", "q", None)]
    cards = html.extract_cards(spark.createDataFrame(rows, "page_id long, site string, query string, html string")).collect()
    got = sorted((c.page_id, c.title, c.url) for c in cards if c.error is None)
    assert got == [(1, "Deep", ""), (2, "Job 1", "/1"), (2, "Job 2", "/2")]
    assert [c.page_id for c in cards if c.error] == [3]


def test_all_cards_are_kept_without_a_cap(spark):
    items = "".join(f'<li><a href="/j/{i}">Job {i}</a></li>' for i in range(60))
    pages = spark.createDataFrame([(1, "https://b.example.com/list", f"<ul>{items}</ul>")], "page_id long, url string, html string")
    assert html.clean_postings(html.extract_list_cards(pages)).count() == 60


def test_arrival_order_of_postings(spark, tmp_path):
    from pyspark.sql import functions as F
    from postline.sources import tables as tb
    cols = "site string, query string, position int, title string, company string, url string, location string, description string"
    for k in (2, 0, 1):
        df = spark.createDataFrame([("s", "q", i, f"{k}-{i}", "c", "u", None, None) for i in range(3)], cols).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "p"))
    got = tb.scan_postings(spark, str(tmp_path / "p")).orderBy("seq").collect()
    assert [r.title for r in got] == [f"{k}-{i}" for k in (2, 0, 1) for i in range(3)] and len({r.seq for r in got}) == 9
    spark.createDataFrame([("s", "q", 1, "t", "c", "u", None, None, 77)], cols + ", seq long").write.parquet(str(tmp_path / "q"))
    assert tb.scan_postings(spark, str(tmp_path / "q")).select(F.col("seq")).first()[0] == 77


def test_arrival_order_of_json_files(spark, tmp_path):
    """Files in the order of their times, lines in the order of the file, however it is cut into blocks."""
    import json
    import os

    from postline.sources import tables as tb
    want = []
    for k, name in enumerate(("b", "a", "c")):
        lines = [f"{name}{i}" for i in range(4000 if name == "a" else 3)]
        path = tmp_path / f"{name}.json"
        path.write_text("".join(json.dumps({"site": "s", "title": t, "description": "x" * 50}) + "\n" for t in lines))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = tb.scan_postings(spark, str(tmp_path), "json")
        assert got.schema.simpleString().startswith("struct<site:string,query:string,position:int,title:string")
        rows = got.select("title", "seq").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.title for r in rows] == want and len({r.seq for r in rows}) == len(want)


def test_board_pages_are_dealt_by_rows(spark, tmp_path):
    """A small file of many parts is parsed by several tasks (keys may be null or repeat)."""
    keys = F.when(F.col("id") % 1000 != 7, F.col("id") % 8000)
    part = spark.range(9000).select(keys.alias("p_partkey"), F.format_string("name %d <i>", "id").alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    pages = registry._board_pages(spark, str(tmp_path))
    sizes = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 9000 and max(sizes) <= 1.1 * registry.BOARD_PAGES_PER_TASK
    got = registry.s3_boards(spark, str(tmp_path)).groupBy(F.col("site").isNull(), "position").count().collect()
    assert sorted(map(tuple, got), key=str) == [(False, 1, 8991), (False, 2, 8991), (True, None, 9)]


def test_cached_start_tags_read_like_others():
    """The same cards, whether a start tag is read from the cache or, for its form, by the standard parser."""
    body = "<DIV class='job-content  x'><div class=\"job-content-title\"><a href='/jobs/1'>t</a></div><title><div class='job-location'></title>" \
           "<p class='company'>c<div CLASS='city'>l</div></div>"
    forms = [body, body.replace("'>", "' >").replace('">', '" >'), body.replace("<a href='/jobs/1'>", "<a href=/jobs/1 x>"), f"<!-- {body} -->" + body]
    cards = [html._extract_page(x, "alljobs", False) for x in forms]
    assert cards[0] == [("t", "c", "/jobs/1", "l")] and cards == cards[:1] * 4
