"""Rule tables.

FIXED VALUES: the lists below must equal the behaviour being reproduced
(rejection patterns, allow-lists, keywords, tracking-parameter names,
thresholds).  They are stated plainly, in their natural order; list order
matters wherever "first match wins".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES -- location rejection (P5): lowercase substrings, list order
# ---------------------------------------------------------------------------
REJECTED_LOCATIONS = [
    "usa", "united states", "u.s.", "new york", "san francisco", "california",
    "texas", "seattle", "boston", "chicago", "los angeles", "austin",
    "canada", "toronto", "vancouver",
    "uk", "united kingdom", "london", "manchester",
    "germany", "berlin", "munich",
    "france", "paris",
    "netherlands", "amsterdam",
    "india", "bangalore", "hyderabad", "mumbai", "delhi",
    "australia", "sydney", "melbourne",
    "singapore",
    "eilat",
    "europe",
    "north america",
    "remote (us only)", "remote (usa only)", "us remote", "usa remote",
    "remote (uk only)", "remote (eu only)",
    ", ny", ", ca", ", tx", ", ma", ", il", ", wa", ", fl", ", co", ", nj", ", ga", ", md", ", va",
]

# FIXED VALUES -- overseas company / title patterns (P6), list order
OVERSEAS_COMPANY_PATTERNS = [
    "university of california", "ucsb", "iowa", "teachiowa",
    "american credit", "amazon.com services llc", "goodreads llc",
    "mod op", "penn state", "pennsylvania", "purdue", "mit ", "stanford",
    "laurel hill school", "cam edu", "summer camp", "camp counselor", "camp specialist",
    "uc berkeley", "carnegie mellon", "harvard", "yale", "princeton", "columbia",
    "university of ", "college of ", "institute of technology", "polytechnic",
    "university hospital", "medical center", "health system",
    "amazon web services", "aws inc", "facebook", "meta platforms", "google llc",
    "preschool", "kindergarten",
]

# FIXED VALUES -- local universities allowed by P7
LOCAL_UNIVERSITIES = [
    "tel aviv", "technion", "hebrew", "bar ilan", "ariel", "haifa", "reichman",
    "idc", "open university", "weizmann",
]
UNIVERSITY_MARKERS = ["university", "college"]

# FIXED VALUES -- seniority keywords (P9), used as \b<kw>\b regexes, unescaped
SENIORITY_KEYWORDS = [
    "senior", "sr.", "lead", "principal", "architect", "manager", "director",
    "vp", "head", "staff",
]
SENIORITY_EXEMPTIONS = ["student", "intern"]

# FIXED VALUES -- experience requirement regexes (P10), Python/Java syntax
EXPERIENCE_PATTERNS = [
    r"\b(?:[3-9]|\d{2})\+\s*(?:years|yrs)\b",
    r"\b(?:[3-9]|\d{2})\s*(?:years|yrs)\s*(?:of\s+)?experience\b",
    r"\b(?:[3-9]|\d{2})-(?:[4-9]|\d{2})\s*(?:years|yrs)\b",
    r"\b(?:three|four|five|six|seven|eight|nine|ten)\s*(?:years|yrs)\s*(?:of\s+)?experience\b",
]
EXPERIENCE_REASON = "Requires prior professional experience (3+ years)"

# FIXED VALUES -- tracking parameters dropped by the store (F1): exact keys
STORE_TRACKING_PARAMS = [
    "trackingId", "trk", "ref", "utm_source", "utm_medium",
    "utm_campaign", "utm_content", "source", "si", "currentJobId",
    "recommended_job", "lipi", "midToken", "rc", "vertical", "searchId",
]

# FIXED VALUES -- tracking parameters dropped at crawl time (F2): any key that
# starts with one of these, ignoring case
CRAWL_TRACKING_PARAMS = [
    "trackingId", "trk", "ref", "utm_source", "utm_medium", "utm_campaign", "utm_content",
    "source", "si", "currentJobId", "recommended_job", "lipi", "midToken", "rc", "vertical",
    "searchId", "utm_term", "utm_id", "utm_partner", "sc_upedinshare", "clickedTrackingId",
    "li_fat_id", "blurredFields", "refId", "ro", "sortBy", "f_TPR", "f_WT", "f_PP",
]

# FIXED VALUES -- request blocking
TRACKER_PATTERNS = [
    "google-analytics", "doubleclick", "facebook.net", "hotjar", "amplitude", "segment",
    "googleadservices", "googlesyndication", "analytics", "beacon", "track", "pixel",
]
BLOCKED_RESOURCE_TYPES = ["image", "media", "font", "imageset", "webp", "stylesheet"]

# FIXED VALUES -- stages
STAGES = ["To Apply", "Applied", "In Process", "Declined", "Irrelevant"]
SUB_STAGES = ["HR Screen", "Home Assignment", "Tech Interview", "Manager Interview", "Offer"]
ACTIVE_STAGES = ["To Apply", "In Process"]          # Applied is not tracked
BOARD_STAGES = ["To Apply", "Applied", "In Process", "Declined"]
# Dedup survivorship rank; any other stage ranks 1
STAGE_RANK = {"Applied": 3, "To Apply": 2, "Irrelevant": 1}

# FIXED VALUES -- thresholds
RELEVANCE_THRESHOLD = 70
HIGH_SCORE_BADGE = 85
SCORE_TIERS = [(95, None, "tier_95"), (85, 95, "tier_85"), (70, 85, "tier_70")]
CIRCUIT_OPEN_AT = 15
FAILING_AT = 5
DEGRADED_BELOW = 0.5
BREAKER_THRESHOLD = 5
BREAKER_RECOVERY_SECONDS = 300
CACHE_TTL_SECONDS = 3600
CACHE_MAX_ENTRIES = 256
CARDS_PER_TASK = 40
MESSAGE_LIMIT = 1550
TRUNCATION_SUFFIX = "\n...(truncated)"
MAIL_BODY_LIMIT = 2000

# FIXED VALUES -- sentinels
NOT_SPECIFIED = "Not specified"
UNKNOWN_COMPANY = "Unknown"
DEFAULT_CARD_LOCATION = "Israel"
RECHECK_DEFAULT_TEXT = "Re-evaluating based on updated strict geographical and student rules."

# FIXED VALUES -- scoring prompt (P23): the labelled lines, then the answer schema
PROMPT_LABELS = ["Evaluate this job posting:\n\nJob Title: ", "\nCompany: ", "\nLocation: ", "\nDescription: "]
PROMPT_TAIL = ("\n\nRespond ONLY with a valid JSON object exactly following this schema (no markdown, no code blocks, "
               "no extra text):\n{\"is_relevant\": true/false, \"match_score\": integer(0-100), \"summary\": \"string\", "
               "\"location\": \"string\", \"key_features\": \"string\", \"important_qualifications\": \"string\"}\n")

# FIXED VALUES -- the six boards: (site, base url, search url prefix, suffix)
SITES = [
    ("linkedin", "https://www.linkedin.com", "https://www.linkedin.com/jobs/search?keywords=", "&location=Israel&f_AL=true"),
    ("indeed", "https://www.indeed.com", "https://www.indeed.com/jobs?q=", "&l=Israel"),
    ("jobmaster", "https://www.jobmaster.co.il", "https://www.jobmaster.co.il/jobs/?q=", ""),
    ("drushim", "https://www.drushim.co.il", "https://www.drushim.co.il/jobs/search/", "/"),
    ("alljobs", "https://www.alljobs.co.il", "https://www.alljobs.co.il/SearchResults.aspx?position=", "&type=0&city=0"),
    ("nisha", "https://www.nisha.co.il", "https://www.nisha.co.il/jobs/?s=", ""),
]

# FIXED VALUES -- default crawl queries
DEFAULT_QUERIES = [
    "Student Developer", "Python Student", "Software Engineer Student",
    "Data Engineer Junior", "Junior Software Engineer", "Junior Python Developer",
    "Junior Data Analyst", "בוגר מדעי המחשב", "משרת סטודנט",
]

# FIXED VALUES -- mail providers: (name, host, port)
MAIL_PROVIDERS = [
    ("gmail", "imap.gmail.com", 993),
    ("outlook", "outlook.office365.com", 993),
    ("yahoo", "imap.mail.yahoo.com", 993),
    ("icloud", "imap.mail.me.com", 993),
]

# FIXED VALUES -- parts of a mail domain that name its provider, in order;
# any other domain counts as the first provider above
PROVIDER_MARKS = [
    ("gmail", ["gmail.com"]),
    ("outlook", ["outlook", "office365", "live.", "hotmail."]),
    ("yahoo", ["yahoo"]),
    ("icloud", ["icloud.com", "me.com"]),
]

# FIXED VALUES -- card selectors per board, each an ordered fallback list
# (card, title, company, link, location)
SITE_SELECTORS = {
    "linkedin": (
        [".base-card", "li[data-view-name='jobs-frontend']", ".jobs-search-results__list-item"],
        [".base-search-card__title", ".job-search-card__title", "h3 a", ".base-card__title"],
        [".base-search-card__subtitle", ".job-card__company-name", ".base-card__subtitle"],
        [".base-card__full-link", ".job-search-card__title-link", "h3 a"],
        [".job-search-card__location", ".base-search-card__metadata span:last-child"],
    ),
    "indeed": (
        [".job_seen_beacon", ".jobsearch-ResultsList > li"],
        ["h2.jobTitle span", "[data-testid='jobTitle-link']", "h2 a span"],
        ["[data-testid='company-name']", ".companyName", "span.company"],
        ["h2.jobTitle a", "[data-testid='jobTitle-link'] a", "h2 a"],
        ["[data-testid='text-location']", ".companyLocation"],
    ),
    "jobmaster": (
        [".JobItem", ".job-item", "[data-job-id]"],
        ["[data-testid='job-content-list'] > a", ".CardHeader"],
        [".CardHeader + div", ".companyNameLink", ".company-name"],
        [".CardHeader a", "a[href*='jobs/']"],
        [".jobLocation", ".JobItemCity", ".location"],
    ),
    "drushim": (
        [".job-item-main"],
        [".job-url", ".job-title", "h3 a", "h2 a"],
        [".company-name", ".company"],
        [".job-url", ".job-title a", "h3 a"],
        [".job-location", ".location", ".city"],
    ),
    "alljobs": (
        [".job-content", ".job-item"],
        [".job-content-title a", ".job-title a", "h2 a", ".title a", "a[data-testid='job-link']"],
        [".job-content-company", ".company-name", ".company"],
        [".job-content-title a", ".job-title a", "h2 a"],
        [".job-content-location", ".location", ".city"],
    ),
    "nisha": (
        [".job-listing", ".job_listing", ".job-item", "article.job"],
        ["h3 a", "h2 a", ".job-title a", "a.job-link"],
        [".company", ".employer", ".company-name"],
        ["h3 a", "h2 a", ".job-title a"],
        [".location", ".city", ".job-location"],
    ),
}


RULE_SETS = [
    ("rejected_location", REJECTED_LOCATIONS),
    ("overseas_company", OVERSEAS_COMPANY_PATTERNS),
    ("local_university", LOCAL_UNIVERSITIES),
    ("seniority", SENIORITY_KEYWORDS),
    ("experience", EXPERIENCE_PATTERNS),
    ("store_tracking", STORE_TRACKING_PARAMS),
    ("crawl_tracking", CRAWL_TRACKING_PARAMS),
    ("tracker", TRACKER_PATTERNS),
    ("blocked_type", BLOCKED_RESOURCE_TYPES),
    ("query", DEFAULT_QUERIES),
]


def rules_frame(spark: SparkSession) -> DataFrame:
    """Every ordered pattern list as one ``(rule_set, ordinal, pattern)`` table.

    Its size is fixed by the lists above (a few hundred rows), so joins
    against it may be broadcast safely.
    """
    rows = []
    for name, values in RULE_SETS:
        rows.extend((name, i + 1, v) for i, v in enumerate(values))
    schema = T.StructType([
        T.StructField("rule_set", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("pattern", T.StringType(), False),
    ])
    return spark.createDataFrame(rows, schema)


def priorities_frame(spark: SparkSession, path: str) -> DataFrame:
    """The priorities text as an ordered table (ordinal, line); no rows
    if the file is empty."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\r?\n")).alias("p", "line"))
    return lines.where(F.trim("line") != "").select((F.col("p") + 1).alias("ordinal"), "line")


def system_prompt(priorities: DataFrame, profile: str | Column = "") -> DataFrame:
    """The scorer's instructions (one row, ``prompt``) from the profile (text or a column) and
    the ordered priorities; the wording is this package's."""
    body = priorities.agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY ordinal)").alias("_t"))
    return body.select(F.concat(F.lit(SYSTEM_PROMPT_HEAD), profile if isinstance(profile, Column) else F.lit(profile), F.lit(SYSTEM_PROMPT_PRIORITIES), F.coalesce("_t", F.lit("")),
                                F.lit(SYSTEM_PROMPT_TAIL)).alias("prompt"))


SYSTEM_PROMPT_HEAD = "You rate job postings for one candidate.\n\nPROFILE\n"
SYSTEM_PROMPT_PRIORITIES = "\n\nPRIORITIES\n"
SYSTEM_PROMPT_TAIL = ("\n\nThe priorities decide. Give match_score inside the band of the tier that they name. "
                      "A posting that breaks a REJECT rule gets is_relevant false and match_score 0; when in doubt, reject.\n")


def site_profile(index: Column) -> Column:
    """The board profile at 0-based ``index`` as a struct (site, base_url,
    search_prefix, search_suffix), from an array literal: no join."""
    arr = F.array(*[F.struct(F.lit(s).alias("site"), F.lit(b).alias("base_url"), F.lit(p).alias("search_prefix"),
                             F.lit(x).alias("search_suffix")) for s, b, p, x in SITES])
    return F.element_at(arr, (index + 1).cast("int"))


def sites_frame(spark: SparkSession) -> DataFrame:
    schema = "site string, base_url string, search_prefix string, search_suffix string, site_ord int"
    return spark.createDataFrame([(s, b, p, x, i + 1) for i, (s, b, p, x) in enumerate(SITES)], schema)


def queries_frame(spark: SparkSession, queries: list[str] | None = None) -> DataFrame:
    qs = DEFAULT_QUERIES if queries is None else queries
    return spark.createDataFrame([(q, i + 1) for i, q in enumerate(qs)], "query string, query_ord int")
