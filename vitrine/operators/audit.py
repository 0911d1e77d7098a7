"""Audits: secrets in text, source validation, acceptance and sequence checks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators import hamming as H
from vitrine.operators.catalogue import seeded_sample

# Rules (label, pattern, severity) and extensions that are not text.
RULES = [
    ("private key block", r"-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY", "block"),
    ("GitHub token", r"gh[pousr]_[A-Za-z0-9]{16,}", "block"),
    ("AWS access key", r"AKIA[0-9A-Z]{16}", "block"),
    ("Slack token", r"xox[baprs]-[0-9A-Za-z-]{10,}", "block"),
    ("Google API key", r"AIza[0-9A-Za-z_\-]{35}", "block"),
    ("generic secret assignment",
     r"(?i)(api[_-]?key|secret|password|passwd|token)\s*[:=]\s*[\"'][A-Za-z0-9/+_\-]{16,}[\"']", "block"),
    ("Apple ASC key id", r"AuthKey_[A-Z0-9]{10}", "warn"),
    ("Windows absolute path", r"[A-Za-z]:[\\/](Users|cowork)[\\/]", "warn"),
    ("email address", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "warn"),
]
SKIP_EXTENSIONS = ["bin", "png", "jpg", "jpeg", "ico", "woff", "woff2", "zip"]
EXCERPT = 70


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _lines(parts: Column, hits: Column) -> Column:
    """The line each hit begins on, from the pieces around the hits."""
    here = F.transform(hits, lambda h, i: _newlines(F.get(parts, i)) + F.when(i > 0, _newlines(F.get(hits, i - 1))).otherwise(0))
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("lines"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["lines"], F.array(acc["at"] + n)).alias("lines"))
    return F.aggregate(here, start, step, lambda acc: acc["lines"])


def audit_text(
    docs: DataFrame, rules=RULES, allowed_emails: list[str] = (), key: str = "doc_id", text: str = "text", path: str | None = None,
) -> DataFrame:
    """Findings of every rule over whole texts: ``line, label, hit, severity``.

    Only matching texts are split at their matches. The line of a match is one more than the newlines in everything
    before it, summed inside the row over the pieces between matches: nothing is shuffled, and rows of equal keys do not mix.
    """
    if path is not None:
        ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
        docs = docs.filter(~ext.isin(SKIP_EXTENSIONS))
    body = F.col(text)
    # Patterns are literals, compiled once. A text meets every rule up to its
    # first match; only rules that match it then search it in full, in the row.
    found = F.array_compact(F.array(*[
        F.when(body.rlike(pattern), F.struct(
            F.lit(label).alias("label"), F.lit(severity).alias("severity"), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("hits"),
            F.split(body, pattern, -1).alias("parts")))
        for label, pattern, severity in rules
    ]))
    some = docs.filter(functools.reduce(lambda a, b: a | b, [body.rlike(pattern) for _, pattern, _ in rules]))
    per_rule = some.select(key, F.inline(found))
    each = per_rule.select(key, "label", "severity", F.inline(F.arrays_zip(_lines(F.col("parts"), F.col("hits")).alias("line"), F.col("hits").alias("hit"))))
    out = each.toDF(key, "label", "severity", "line", "hit")
    if allowed_emails:
        out = out.filter(~((F.col("label") == "email address") & F.lower("hit").isin([e.lower() for e in allowed_emails])))
    return out.select(key, "line", "label", F.substring("hit", 1, EXCERPT).alias("hit"), "severity")


def audit_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "label").agg(F.count("*").alias("findings"))


def audit_verdict(findings: DataFrame) -> DataFrame:
    """One row: blocking and warning counts, and whether publication may go on."""
    n = lambda s: F.coalesce(F.sum((F.col("severity") == s).cast("bigint")), F.lit(0))
    return findings.agg(n("block").alias("blocking"), n("warn").alias("warnings")).withColumn("passed", F.col("blocking") == 0)


def validate_source(
    primary: DataFrame, fallback: DataFrame, n_words: int, n: int = 40, max_median: int = 120, seed: int = 5, key: str = "row_id",
) -> DataFrame:
    """May the fallback stand in? Median differing bits over a seeded sample of shared ids.

    The sample is the operator's own: it bounds the comparison to n rows.
    """
    shared = primary.select(key, "desc").join(fallback.select(key, F.col("desc").alias("_other")), key)
    picked = seeded_sample(shared, key, n, seed)
    diff = H.diff_versions(picked.select(key, "desc"), picked.select(key, F.col("_other").alias("desc")), n_words, key)
    return diff.agg(F.count("*").alias("compared"), F.expr("percentile(diff_bits, 0.5)").alias("median_bits")).withColumn(
        "accepted", F.coalesce(F.col("median_bits") < max_median, F.lit(False)))


def no_false_accepts(reads: DataFrame, is_negative: Column) -> DataFrame:
    """Reads known to show nothing must yield no accepted row."""
    return reads.filter(is_negative).agg(
        F.count("*").alias("negatives"), F.coalesce(F.sum(F.col("accepted").cast("bigint")), F.lit(0)).alias("false_accepts"),
    ).withColumn("passed", F.col("false_accepts") == 0)


def sequence_report(emitted: DataFrame, truth: DataFrame, frames: DataFrame, min_coverage: float = 0.8, min_reuse: float = 0.5) -> DataFrame:
    """Exact, reprint and wrong hits, duplicates, coverage and reuse of a sequence.

    ``truth``: ``presentation, want, want_name``; ``emitted``: ``presentation,
    got, got_name``; ``frames``: ``reused``.
    """
    joined = truth.join(emitted, "presentation", "left")
    exact = F.col("got") == F.col("want")
    reprint = ~exact & (F.col("got_name") == F.col("want_name"))
    per = joined.groupBy("presentation").agg(
        F.count("got").alias("hits"), F.coalesce(F.sum(exact.cast("bigint")), F.lit(0)).alias("exact"),
        F.coalesce(F.sum(reprint.cast("bigint")), F.lit(0)).alias("reprint"))
    total = per.agg(
        F.count("*").alias("presentations"), F.sum("hits").alias("emitted"), F.sum("exact").alias("exact"), F.sum("reprint").alias("reprint"),
        F.sum((F.col("hits") > 1).cast("bigint")).alias("duplicated"), F.sum((F.col("hits") > 0).cast("bigint")).alias("seen"),
    ).withColumn("_one", F.lit(1))
    reuse = frames.agg(F.count("*").alias("frames"), F.coalesce(F.sum(F.col("reused").cast("bigint")), F.lit(0)).alias("reused")).withColumn("_one", F.lit(1))
    out = total.join(reuse, "_one").drop("_one").withColumn("wrong", F.col("emitted") - F.col("exact") - F.col("reprint"))
    return out.withColumn(
        "passed",
        (F.col("wrong") == 0) & (F.col("duplicated") == 0) & (F.col("seen") >= F.ceil(F.col("presentations") * min_coverage))
        & (F.col("reused") / F.col("frames") > min_reuse))
