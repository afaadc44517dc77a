"""Quality rules: fixed rules, then robust multivariate outliers.

DataFrame functions only.  ``statistics`` counts per text; ``judge`` applies
the base rules and, to what they leave, a minimum-covariance-determinant (MCD)
estimate per language and source.

Words are runs of anything but ASCII white space (null text: none).  Base
rules reject a text of fewer than 50 words, or one with more than half of its words in
three-word windows that occur twice or more in it.

The statistic vector of a text is transformed so that ordinary texts are
roughly normal: log of mean word length, log of symbols per hundred words
(damped), share of duplicate lines (damped), share of repeated words.  Each cell (language and
source; the language alone, then all texts, where a cell has fewer than
``min_cell`` texts) starts from medians and median deviations; concentration
steps then take mean and covariance of the texts within the ``coverage`` quantile
of the distances, four times.  The scale is made consistent by the median
distance, variances have a floor (a statistic that is constant in a cell must not
reject the first text that differs a little), and texts whose squared Mahalanobis
distance exceeds ``cutoff`` are rejected.

Scale: texts are read once and reduced to a narrow table that is written;
all later passes are partial aggregates over that table, joined with one row
per cell.  Quantiles are sketches of bounded size.  A hot source is one
partial row per task.

Edge cases: null or empty texts fail the base rules; null language or source is a
cell value of its own (shared with the empty string); with fewer than
``min_cell`` texts in all, only the base rules judge; repeated rows are
judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline.llm import textops as X
from postline.llm.textops import let
from postline.session import written

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
COVERAGE = 0.75
MIN_CELL = 100
MAX_CELLS = 100_000          # cells that may be broadcast
STEPS = 4
CUTOFF = 75.0
DIMS = 4
CHI2_MEDIAN = 3.3567          # median of chi-square with DIMS degrees of freedom
FLOOR = (0.05, 0.35, 0.06, 0.06)   # least standard deviation of each statistic

SPLIT = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT), "")


def repeat_words(w: Column) -> Column:
    """Words in three-word windows found twice or more.  Windows are sorted
    by hash, so equal ones are neighbours; their positions, sorted again, cover
    three words each, less where the next one follows closer."""
    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
                           F.lit(0), lambda a, b: a + b)

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.when(i > 0, F.get(s, i - 1)["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            let(F.sort_array(pairs), lambda s: let(positions(s), covered)))

    def windows(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))

    return F.when(F.size(w) < 4, 0).otherwise(let(windows(w), count))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines (lines with a
    word), n_dup_lines, n_repeat_words, all long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    found = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                                                repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                             (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return (docs.withColumns({"_w": found, "_l": of_lines,
                              "n_symbols": (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("long")})
            .select(*docs.columns, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics of a text that passed the base rules."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))),
            F.log1p(F.col("n_symbols") / (0.5 + 0.01 * n)),
            F.col("n_dup_lines") / (F.col("n_lines") + 5.0),
            F.col("n_repeat_words") / n]


def _x(i: int) -> Column:
    return F.col(f"x{i}")


def _square_distance(center: str = "m", factor: str = "l") -> Column:
    """Squared Mahalanobis distance by forward substitution through the
    Cholesky factor (columns l<i><j>) of the cell's covariance."""
    y: list[Column] = []
    for i in range(DIMS):
        rest = _x(i) - F.col(f"{center}{i}")
        for j in range(i):
            rest = rest - F.col(f"{factor}{i}{j}") * y[j]
        y.append(rest / F.col(f"{factor}{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _cholesky(cov: DataFrame) -> DataFrame:
    """Adds the factor's columns to a table with columns c<i><j> (j <= i);
    variances get their floor first."""
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            cov = cov.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return cov


def _cells(vectors: DataFrame, min_cell: int) -> DataFrame:
    """One row per (language, source) that has a cell: the cell that judges it."""
    pairs = written(vectors.groupBy("g_lang", "g_source").agg(F.count("*").alias("n")), "quality_pairs")
    langs = pairs.groupBy("g_lang").agg(F.sum("n").alias("n_lang"))
    n_all = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    none = F.lit(None).cast("string")
    return (pairs.join(langs, "g_lang")
            .select("g_lang", "g_source",
                    F.when(F.col("n") >= min_cell, F.struct("g_lang", "g_source"))
                    .when(F.col("n_lang") >= min_cell, F.struct("g_lang", none.alias("g_source")))
                    .when(F.lit(n_all >= min_cell), F.struct(none.alias("g_lang"), none.alias("g_source")))
                    .alias("cell"))
            .where("cell is not null").withColumn("cell", F.to_json("cell")))


def _small(table: DataFrame, name: str) -> DataFrame:
    """A table of one row a cell, written; sent to all tasks if it has no more than ``MAX_CELLS`` rows."""
    table = written(table, name)
    return F.broadcast(table) if table.count() <= MAX_CELLS else table


def estimates(vectors: DataFrame, coverage: float = COVERAGE, min_cell: int = MIN_CELL, steps: int = STEPS) -> DataFrame:
    """MCD estimates: one row per (g_lang, g_source) with the center m<i>, the
    Cholesky factor l<i><j> and the scale s of its cell."""
    cells = _small(_cells(vectors, min_cell), "quality_cells")
    rows = vectors.join(cells, ["g_lang", "g_source"])

    def quantile(col, q):
        return F.percentile_approx(col, F.lit(q), F.lit(10000))

    start = rows.groupBy("cell").agg(*[quantile(_x(i), 0.5).alias(f"m{i}") for i in range(DIMS)])
    start = _small(start, "quality_start")
    spread = rows.join(start, "cell").groupBy("cell").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIMS)],
        *[F.pow(quantile(F.abs(_x(i) - F.col(f"m{i}")), 0.5) * 1.4826, F.lit(2)).alias(f"c{i}{i}") for i in range(DIMS)])
    for i in range(DIMS):
        for j in range(i):
            spread = spread.withColumn(f"c{i}{j}", F.lit(0.0))
    model = _small(_cholesky(spread), "quality_model")
    for _ in range(steps):
        near = rows.join(model, "cell").select("cell", *[f"x{i}" for i in range(DIMS)], _square_distance().alias("d"))
        limit = _small(near.groupBy("cell").agg(quantile("d", coverage).alias("limit")), "quality_limit")
        half = near.join(limit, "cell").where("d <= limit").groupBy("cell").agg(
            *[F.avg(_x(i)).alias(f"m{i}") for i in range(DIMS)],
            *[F.covar_pop(_x(i), _x(j)).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)])
        model = _small(_cholesky(half), "quality_model")
    scale = (rows.join(model, "cell").groupBy("cell")
             .agg((F.greatest(quantile(_square_distance(), 0.5) / CHI2_MEDIAN, F.lit(1.0))).alias("s")))
    return cells.join(model, "cell").join(scale, "cell")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          cutoff: float = CUTOFF, coverage: float = COVERAGE, min_cell: int = MIN_CELL, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the statistics, base_failed, distance (squared
    Mahalanobis, null where none is taken) and kept; and the columns ``keep``."""
    found = statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                                   F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("g_lang"),
                                   F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("g_source"), *keep)).drop("text")
    found = written(found.withColumn("base_failed", base_failed()), "quality_statistics")
    vectors = found.where("not base_failed").select("g_lang", "g_source", *[v.alias(f"x{i}") for i, v in enumerate(vector())])
    model = _small(estimates(vectors, coverage, min_cell), "quality_estimates")
    judged = found.withColumns({f"x{i}": v for i, v in enumerate(vector())}).join(model, ["g_lang", "g_source"], "left")
    distance = F.when(~F.col("base_failed"), _square_distance() / F.col("s"))
    return (judged.withColumn("distance", distance)
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept", *keep))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The documents (all their columns) that are kept.  Rows are judged, not
    ids: a verdict goes to the rows of its id, text, language and source."""
    key = X.fresh(docs, "_judged")
    named = docs.withColumn(key, F.xxhash64(X.text_name(F.col(text_col)), F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
                                            F.coalesce(F.col(source_col).cast("string"), F.lit(""))))
    rejected = judge(named, id_col, text_col, lang_col, source_col, keep=(key,), **options).where("not kept")
    return X.drop_ids(named, rejected.select("doc_id", key), [id_col, key]).drop(key)
