"""Pluggable scorer and classifier.

The built-in scorer is the rule score F18 and the built-in classifier the
keyword rules -- both native expressions.  A user-supplied callable (for
instance a model client) runs per partition in ``mapInPandas``: one
client per task, Arrow batches in and out, and its raw output is coerced
natively (F6 / F9).  ``mapInPandas`` is evaluated once per row; callers
that branch on the result write it once first (``session.written``, as X4 does).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postline import rules
from postline.functions import evaluation as ev
from postline.sources.mail import keyword_classification

EVAL_FIELDS = ["is_relevant", "match_score", "summary", "location", "key_features", "important_qualifications"]


def default_evaluation(df: DataFrame) -> DataFrame:
    """F18-based evaluation struct for each posting."""
    score = ev.tier_score(F.col("title"), F.col("description"), F.lit(False),
                          F.contains(F.lower(F.coalesce(F.col("description"), F.lit(""))), F.lit("easy apply")))
    return df.withColumn("evaluation", F.struct(
        (score >= rules.RELEVANCE_THRESHOLD).alias("is_relevant"), score.alias("match_score"),
        F.concat(F.lit("Rule score for "), F.coalesce(F.col("title"), F.lit(""))).alias("summary"),
        F.coalesce(F.col("location"), F.lit(rules.NOT_SPECIFIED)).alias("location"),
        F.lit("").alias("key_features"), F.lit("").alias("important_qualifications")))


def evaluation_json(e) -> F.Column:
    """The evaluation struct as ``json.dumps`` text (key order kept)."""
    return F.concat(
        F.lit('{"is_relevant": '), F.when(e["is_relevant"], F.lit("true")).otherwise(F.lit("false")),
        F.lit(', "match_score": '), e["match_score"].cast("string"),
        F.lit(', "summary": '), ev.json_string(F.coalesce(e["summary"], F.lit(""))),
        F.lit(', "location": '), ev.json_string(F.coalesce(e["location"], F.lit(rules.NOT_SPECIFIED))),
        F.lit(', "key_features": '), ev.json_string(F.coalesce(e["key_features"], F.lit(""))),
        F.lit(', "important_qualifications": '), ev.json_string(F.coalesce(e["important_qualifications"], F.lit(""))),
        F.lit("}"))


def _scorer_batches(scorer: Callable | None, cols: list[str], factory: Callable | None = None):
    def run(batches):
        # a factory builds one scorer (e.g. a model client) per task
        score = factory() if factory is not None else scorer
        for pdf in batches:
            raw = []
            for rec in pdf[cols].to_dict("records"):
                try:
                    out = score(rec)
                    raw.append(out if isinstance(out, str) else json.dumps(out))
                except Exception as e:
                    raw.append(json.dumps({"is_relevant": False, "match_score": 0,
                                           "summary": f"Error evaluating job: {e}"}))
            res = pdf.copy()
            res["raw_evaluation"] = raw
            yield res
    return run


def score_postings(df: DataFrame, scorer: Callable | None = None, max_concurrency: int | None = None,
                   scorer_factory: Callable[[], Callable] | None = None) -> DataFrame:
    """Posting -> ``evaluation`` struct.  ``scorer`` maps a posting dict
    (title, company, location, description) to a dict or JSON text;
    ``scorer_factory`` instead returns such a callable and is invoked once
    per task (one client per task).

    ``max_concurrency`` bounds how many tasks call the scorer at once (an
    external service's rate limit): the postings are spread round-robin over
    that many partitions first.  Rejections must be filtered out *before*
    this call: Catalyst does not push filters below ``mapInPandas``."""
    if scorer is None and scorer_factory is None:
        return default_evaluation(df)
    cols = [c for c in ("title", "company", "location", "description") if c in df.columns]
    schema = T.StructType(df.schema.fields + [T.StructField("raw_evaluation", T.StringType())])
    src = df.repartition(max_concurrency) if max_concurrency else df
    scored = src.mapInPandas(_scorer_batches(scorer, cols, scorer_factory), schema)
    return scored.withColumn("evaluation", ev.coerce_evaluation(F.col("raw_evaluation"))).drop("raw_evaluation")


def _classifier_batches(classifier: Callable, body_limit: int | None):
    def run(batches):
        for pdf in batches:
            out = []
            for subj, body, comp in zip(pdf["subject"], pdf["body"], pdf["company_key"]):
                try:
                    r = classifier(subj, (body or "")[:body_limit], comp)
                    out.append(r if isinstance(r, str) else json.dumps(r))
                except Exception:
                    out.append(None)
            res = pdf.copy()
            res["raw_classification"] = out
            yield res
    return run


def classify_messages(df: DataFrame, classifier: Callable | None = None, body_limit: int | None = None) -> DataFrame:
    """(subject, body, company) -> ``classification`` struct.  The built-in
    keyword rules read the whole body; ``body_limit`` bounds the characters
    sent to a (paid) user classifier, none by default."""
    if classifier is None:
        return df.withColumn("classification", keyword_classification(F.col("subject"), F.col("body")))
    schema = T.StructType(df.schema.fields + [T.StructField("raw_classification", T.StringType())])
    out = df.mapInPandas(_classifier_batches(classifier, body_limit), schema)
    return out.withColumn("classification", ev.parse_classification(F.col("raw_classification"))).drop("raw_classification")
