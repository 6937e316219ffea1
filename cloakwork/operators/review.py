"""Review decisions, the audit log and its statistics. What isn't decided is masked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.config import MASK
from cloakwork.functions.text import js_trim
from cloakwork.operators.mask import mask_literal


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision for each field: doc_id, field_id, accepted."""
    return decisions.where("field_id IS NOT NULL AND accepted IS NOT NULL").groupBy("doc_id", "field_id").agg(F.max_by("accepted", F.struct("decided_at", "accepted")).alias("accepted"))


def audit(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings with action (masked, skipped, pending) and final_value."""
    both = findings.join(last_decisions(decisions), ["doc_id", "field_id"], "left")
    action = F.when(F.col("accepted").isNull(), "pending").when(F.col("accepted"), "masked").otherwise("skipped")
    return both.withColumn("action", action).withColumn("final_value", F.when(F.col("action") == "skipped", F.col("original_value")).otherwise(MASK)).drop("accepted")


def _counts(*extra: str):
    acts = [F.count_if(F.col("action") == a).alias(a) for a in ("masked", "skipped", "pending")]
    return [F.count("*").alias("total"), *acts]


def export_stats(log: DataFrame) -> DataFrame:
    """Totals for each document; the rate counts what is pending as masked."""
    rate = F.floor((F.col("masked") + F.col("pending")) * 100.0 / F.col("total") + 0.5).cast("long")
    return log.groupBy("doc_id").agg(*_counts()).withColumn("masked_rate", rate)


def category_stats(log: DataFrame) -> DataFrame:
    """total, masked (pending included) and skipped for each document and category, with the place of its first finding."""
    skipped = F.count_if(F.col("action") == "skipped")
    return log.groupBy("doc_id", "field_name").agg(F.count("*").alias("total"), (F.count("*") - skipped).alias("masked"), skipped.alias("skipped"), F.min("position").alias("first_position"))


def stats_rollup(log: DataFrame) -> DataFrame:
    """Both statistics in one pass: grouping sets of document and document with category."""
    sets = log.groupingSets([["doc_id"], ["doc_id", "field_name"]], "doc_id", "field_name")
    return sets.agg(*_counts())


def confirm_stats(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """total, masked, skipped and rate after a confirmation; only rejections of known fields count."""
    rejected = last_decisions(decisions).where("NOT accepted").select("doc_id", "field_id", F.lit(True).alias("rejected"))
    counted = findings.join(rejected, ["doc_id", "field_id"], "left").groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("rejected").alias("skipped"))
    masked = F.col("total") - F.col("skipped")
    return counted.select("doc_id", "total", masked.alias("masked"), "skipped", F.floor(masked * 100.0 / F.col("total") + 0.5).cast("long").alias("masked_rate"))


def applied(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """How many decisions of each document name a finding."""
    return last_decisions(decisions).join(findings.select("doc_id", "field_id"), ["doc_id", "field_id"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("applied"))


def unknown_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that name no finding."""
    return last_decisions(decisions).join(findings.select("doc_id", "field_id"), ["doc_id", "field_id"], "left_anti")


def remaining(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Distinct values that stay to be masked, at the place of their first finding: doc_id, original_value, first_position."""
    rejected = last_decisions(decisions).where("NOT accepted")
    left = findings.join(rejected, ["doc_id", "field_id"], "left_anti").where(F.length(js_trim(F.col("original_value"))) >= 2)
    return left.groupBy("doc_id", "original_value").agg(F.min("position").alias("first_position"))


def reconcile_counts(findings: DataFrame) -> DataFrame:
    """From detectors, from patterns alone, and unverified, for each document."""
    return findings.groupBy("doc_id").agg(F.count_if(F.col("source") != "pattern").alias("from_ai"), F.count_if(F.col("source") == "pattern").alias("pattern_only"), F.count_if(~F.col("verified")).alias("unverified"))


def confirm_category_stats(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """total, masked and skipped for each document and category after a confirmation; what isn't rejected is masked."""
    rejected = last_decisions(decisions).where("NOT accepted").select("doc_id", "field_id", F.lit(True).alias("rejected"))
    skipped = F.count_if(F.coalesce("rejected", F.lit(False)))
    return findings.join(rejected, ["doc_id", "field_id"], "left").groupBy("doc_id", "field_name").agg(F.count("*").alias("total"), (F.count("*") - skipped).alias("masked"), skipped.alias("skipped"))


def run_stats(masked_cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Statistics of a run without decisions: all its masked values, under one category."""
    total = F.count("*")
    one = F.array(F.struct(F.lit("AI-Masked").alias("category"), total.alias("total"), total.alias("masked"), F.lit(0).cast("long").alias("skipped")))
    return masked_cells.groupBy(key).agg(total.alias("total"), total.alias("masked"), F.lit(0).cast("long").alias("skipped"), F.lit(0).cast("long").alias("pending"), F.lit(100).cast("long").alias("masked_rate"), one.alias("by_category"))


def exports(docs: DataFrame, log: DataFrame, meta: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, …) and their audit log → doc_id and export: masked document, log, statistics and the meta columns of docs as JSON."""
    entry = F.struct(*[F.col(c) for c in ("position", "field_id", "field_name", "original_value", "final_value", "action", "sensitivity", "source", "confidence", "occurrences")])
    totals = [f.alias(n) for f, n in zip((F.count("*"), *(F.count_if(F.col("action") == a) for a in ("masked", "skipped", "pending"))), ("total", "masked", "skipped", "pending"))]
    logs = log.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("log"), *totals)
    by = category_stats(log).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_position", F.col("field_name").alias("category"), "total", "masked", "skipped"))).alias("by"))
    both = docs.join(logs, "doc_id", "left").join(by, "doc_id", "left").withColumn("log", F.coalesce("log", F.array().cast(logs.schema["log"].dataType)))
    values = F.transform(F.filter("log", lambda x: x["action"] != "skipped"), lambda x: x["original_value"])
    n = {c: F.coalesce(c, F.lit(0)) for c in ("total", "masked", "skipped", "pending")}
    rate = F.when(n["total"] > 0, F.floor((n["masked"] + n["pending"]) * 100.0 / n["total"] + 0.5)).otherwise(0).cast("long")
    stats = F.struct(*[v.alias(k) for k, v in n.items()], rate.alias("masked_rate"), F.transform(F.coalesce("by", F.array().cast(by.schema["by"].dataType)), lambda x: x.dropFields("first_position")).alias("by_category"))
    whole = F.struct(mask_literal(F.col("text"), values).alias("masked_document"), F.transform("log", lambda x: x.dropFields("position")).alias("audit_log"), stats.alias("stats"), F.struct("doc_id", *(meta or [])).alias("meta"))
    return both.select("doc_id", F.to_json(whole).alias("export"))
