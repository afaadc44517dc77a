"""Table access (S1, S2) and adapters from the driver tables to the
posting data model.

Each adapter is a list of SQL expressions valid in both Spark SQL and
DuckDB, applied with ``selectExpr`` on the Spark side; the oracle uses the
very same text inside a CTE, so both engines see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postline import rules

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_STAGE_OF_TYPE = ("CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'To Apply' WHEN p_type = 'SMALL' THEN 'Applied' "
                  "WHEN p_type = 'LARGE' THEN 'In Process' WHEN p_type = 'PROMO' THEN 'Declined' ELSE 'Irrelevant' END")

# V1 jobs <- part
JOBS = [
    "p_partkey AS id",
    "p_name AS title",
    "p_brand AS company",
    "'https://x.example.com/jobs/' || CAST(p_partkey AS STRING) AS url",
    "CAST(DATE '2024-01-01' + CAST(p_partkey % 365 AS INT) AS TIMESTAMP) AS date_found",
    "CASE WHEN p_partkey % 41 = 0 THEN 'Irrelevant: legacy text' "
    "ELSE '{\"is_relevant\": ' || CASE WHEN p_partkey % 3 <> 0 THEN 'true' ELSE 'false' END "
    "|| ', \"match_score\": ' || CASE WHEN p_partkey % 37 = 0 THEN '\"' || CAST(p_size * 2 AS STRING) || '\"' "
    "ELSE CAST(p_size * 2 AS STRING) END "
    "|| ', \"summary\": \"' || p_name || ' role\", \"location\": \"' "
    "|| CASE p_partkey % 4 WHEN 0 THEN 'Tel Aviv' WHEN 1 THEN 'Haifa' WHEN 2 THEN 'London, UK' ELSE 'Remote' END "
    "|| '\", \"key_features\": \"' || p_type || '\", \"important_qualifications\": \"' || p_brand || '\"}' END AS ai_summary",
    f"{_STAGE_OF_TYPE} AS stage",
    "CASE WHEN p_type = 'LARGE' THEN CASE p_partkey % 5 WHEN 0 THEN 'HR Screen' WHEN 1 THEN 'Home Assignment' "
    "WHEN 2 THEN 'Tech Interview' WHEN 3 THEN 'Manager Interview' ELSE 'Offer' END END AS sub_stage",
    "CASE WHEN p_partkey % 2 = 0 THEN 'Not specified' ELSE 'Tel Aviv' END AS location",
]

# V1' jobs tracked by the mail matcher: company is the part name, so that
# senders and subjects built from part names can match it.
MAIL_JOBS = [
    "p_partkey AS id",
    "p_brand AS title",
    "p_name AS company",
    "CAST(DATE '2024-01-01' + CAST(p_partkey % 365 AS INT) AS TIMESTAMP) AS date_found",
    f"{_STAGE_OF_TYPE} AS stage",
]

# V2 located <- customer x nation x region
LOCATED = [
    "c_custkey AS id",
    "c_mktsegment || ' analyst' AS title",
    "c_name AS company",
    "CASE c_custkey % 4 WHEN 0 THEN n_name || ', ' || r_name WHEN 1 THEN 'Tel Aviv, Israel' "
    "WHEN 2 THEN 'Austin, TX' ELSE lower(r_name) || ' office' END AS location",
]

# V3 described <- part
DESCRIBED = [
    "p_partkey AS id",
    "CASE p_size % 5 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Student Lead ' WHEN 2 THEN 'Junior ' WHEN 3 THEN 'Sr. ' "
    "ELSE 'Head of ' END || p_name AS title",
    "CASE p_partkey % 6 WHEN 0 THEN 'Open University' WHEN 1 THEN 'Technion College' WHEN 2 THEN 'Purdue' "
    "WHEN 3 THEN 'Acme' WHEN 4 THEN 'Mod Op' ELSE 'North College' END AS company",
    "CASE p_partkey % 4 WHEN 0 THEN 'Tel Aviv' WHEN 1 THEN 'London, UK' WHEN 2 THEN '  Haifa ' "
    "ELSE 'Remote (US only)' END AS location",
    "p_name || ' ' || CAST(p_size % 8 AS STRING) || '+ years experience' AS description",
    "'https://x.example.com/jobs/' || CAST(p_partkey AS STRING) AS url",
]

# V4 attempts <- events
ATTEMPTS = [
    "event_id AS id",
    "'site_' || CAST(user_id AS STRING) AS site",
    "'q' || CAST(event_id % 9 AS STRING) AS query",
    "CAST(ts AS TIMESTAMP) AS ts",
    "(event_type IN ('click', 'purchase') OR (user_id % 3 = 0 AND event_type <> 'error')) AS success",
    "CASE WHEN event_type IN ('click', 'purchase') OR (user_id % 3 = 0 AND event_type <> 'error') "
    "THEN CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INT) ELSE 0 END AS jobs_found",
    "value AS response_time_ms",
    "CASE WHEN event_type IN ('click', 'purchase') OR (user_id % 3 = 0 AND event_type <> 'error') THEN NULL "
    "ELSE 'TimeoutError: ' || event_type END AS error",
]

# V8 stage_log <- events
STAGE_LOG = [
    "user_id AS id",
    "event_id AS seq",
    "CASE event_type WHEN 'purchase' THEN 'Declined' WHEN 'signup' THEN 'Applied' ELSE 'In Process' END AS new_stage",
    "CASE event_type WHEN 'click' THEN 'HR Screen' WHEN 'view' THEN 'Tech Interview' END AS new_sub_stage",
]

# V7 board <- orders
BOARD = [
    "o_orderkey AS id",
    "'order ' || CAST(o_custkey AS STRING) AS title",
    "o_orderpriority AS company",
    "CASE o_orderstatus WHEN 'O' THEN 'To Apply' WHEN 'F' THEN 'Applied' ELSE 'In Process' END AS stage",
    "CAST(o_totalprice AS BIGINT) % 101 AS score",
    "CAST(o_orderdate AS TIMESTAMP) AS date_found",
]

# V5 messages <- events x part (joined on event_id mod the part count)
MESSAGE_COLS = [
    "event_id AS seq",
    "replace(p_name, ' ', '-') || '@mail.com' AS sender",
    "CASE WHEN event_id % 2 = 0 THEN p_name ELSE 'update' END AS subject",
    "'Thank you for applying. ' || CASE event_type WHEN 'click' THEN 'We would like to invite you to an HR screen.' "
    "WHEN 'purchase' THEN 'Unfortunately we decided not to move forward.' "
    "WHEN 'view' THEN 'Please complete the home assignment.' "
    "WHEN 'signup' THEN 'We received your application.' ELSE 'Our newsletter.' END AS body",
]

# V9 arrivals <- events (needs the row count n)
ARRIVALS = [
    "event_id AS seq",
    "'https://x.example.com/jobs/' || CAST((event_id * 7) % CAST(FLOOR(n / 3) AS BIGINT) AS STRING) AS url",
    "event_type || '-' || CAST((event_id * 13) % CAST(FLOOR(n / 5) AS BIGINT) AS STRING) AS title",
    "'Acme' AS company",
]


def jobs(spark, sf_dir):
    return read(spark, sf_dir, "part").selectExpr(*JOBS)


def mail_jobs(spark, sf_dir):
    return read(spark, sf_dir, "part").selectExpr(*MAIL_JOBS)


def located(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    # nation and region are fixed-size dimension tables (25 and 5 rows)
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .selectExpr(*LOCATED))


def described(spark, sf_dir):
    return read(spark, sf_dir, "part").selectExpr(*DESCRIBED)


def attempts(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr(*ATTEMPTS)


def stage_log(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr(*STAGE_LOG)


def board(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr(*BOARD)


def messages(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    n_part = p.count()                                    # a scalar (footer metadata)
    keyed = e.withColumn("p_partkey", F.col("event_id") % F.lit(n_part))
    return keyed.join(p, "p_partkey").selectExpr(*MESSAGE_COLS)


def arrivals(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.withColumn("n", F.lit(e.count())).selectExpr(*ARRIVALS)


def store_and_batch(spark, sf_dir):
    """Even ids form the stored table, odd ids an incoming batch.  One
    in ten batch rows reuses a stored URL (with a tracking parameter)."""
    j = jobs(spark, sf_dir)
    store = j.where(F.col("id") % 2 == 0)
    batch = (j.where(F.col("id") % 2 == 1)
             .withColumn("url", F.when(F.col("id") % 10 == 1,
                                       F.concat(F.lit("https://x.example.com/jobs/"), (F.col("id") - 1).cast("string"),
                                                F.lit("?trk=feed")))
                         .otherwise(F.col("url"))))
    return store, batch


def scan_jobs(jobs_df: DataFrame, stages=None) -> DataFrame:
    """Rows of the jobs table in one or several stages (pushed to the scan)."""
    if stages is None:
        return jobs_df
    if isinstance(stages, str):
        stages = [stages]
    return jobs_df.where(F.col("stage").isin(list(stages)))


def read_jobs(spark: SparkSession, path: str, stages=None) -> DataFrame:
    """S1 over a stored jobs table (parquet partitioned by stage, so the
    stage predicate prunes whole directories)."""
    return scan_jobs(spark.read.parquet(path), stages)


POSTING_SCHEMA = ("site string, query string, position int, title string, company string, url string, "
                  "location string, description string, seq bigint")


def scan_postings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The raw postings of a cycle, with an explicit schema.  ``seq`` is the
    order of arrival.  Files without it get it from the order of the files
    (modification time, then path) and the row's place in its file, so it doesn't depend on
    how files are packed into tasks.  Parquet knows that place; rows of text formats (JSON, CSV)
    are placed by the start of the block of the file they were read from and their order in it, and
    numbered by a range-partitioned sort."""
    df = spark.read.schema(POSTING_SCHEMA).format(fmt).load(path)
    # one row a file: a small table, numbered in one task
    files = df.select("_metadata.file_path", "_metadata.file_modification_time").distinct()
    numbers = files.select(F.col("file_path").alias("_file"), F.row_number().over(W.orderBy("file_modification_time", "file_path")).alias("_no"))
    if fmt == "parquet":
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")).join(numbers, "_file")
        arrival = F.shiftleft(F.col("_no").cast("bigint"), 40) + F.col("_row")
        return placed.withColumn("seq", F.coalesce("seq", arrival)).drop("_file", "_no", "_row")
    from postline.operators.reports import global_positions
    # within a block of a file, rows come in the order of the file: their ids rise
    read = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_row"))
    placed = read.join(numbers, "_file").withColumn("_all", F.lit(1))
    numbered = global_positions(placed, ["_all"], [F.col("_no"), F.col("_block"), F.col("_row")], out="_n")
    return numbered.withColumn("seq", F.coalesce("seq", F.shiftleft(F.col("_no").cast("bigint"), 40) + F.col("_n"))).drop("_file", "_block", "_row", "_no", "_n", "_all")


__all__ = ["read", "jobs", "located", "described", "attempts", "stage_log", "board", "messages", "arrivals",
           "store_and_batch", "scan_jobs", "read_jobs", "scan_postings", "rules"]
