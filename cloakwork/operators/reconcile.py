"""Detector suggestions and pattern hits, verified against the text and merged into findings.

A document and its suggestions are joined once; all else is done on arrays inside the row: no window, no shuffle, and
so the same plan runs on a stream. A hit gives way to a suggestion of the same key, to a verified suggestion that
contains it and to an earlier hit that contains it. Places, counts, surroundings and containments of all hits and
suggestions of a document come from one automaton (functions.places), so work grows with a text's length and its hits,
not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.places import located_all
from cloakwork.functions.text import category_rank, collapse, let, norm, sensitivity, slug
from cloakwork.operators.scan import distinct_hits, first_of_each


def group_suggestions(suggestions: DataFrame) -> DataFrame:
    """suggestions(doc_id, ai_seq, field_name, original_value, reason, sensitivity) as one sorted array a document."""
    one = F.struct("ai_seq", "field_name", F.coalesce(collapse(F.col("original_value")), F.lit("")).alias("value"), "reason", F.col("sensitivity").alias("level"))
    return suggestions.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("suggested"))


def _finding(item: Column, at: Column, order: Column, ai: bool) -> Column:
    """The finding of a suggestion or a hit; at: what places.located says of it."""
    verified = at["count"] > 0
    category = item["field_name"] if ai else item["category"]
    level = F.coalesce(item["level"], sensitivity(category)) if ai else sensitivity(category)
    reason = F.coalesce(F.nullif(item["reason"], F.lit("")), F.concat(F.lit("Suggested as "), category)) if ai else F.concat(F.lit("Found by a "), F.lower(category), F.lit(" pattern only"))
    source = F.when(verified & at["agrees"], "ai+pattern").otherwise("ai") if ai else F.lit("pattern")
    confidence = F.when(~verified, 40).when(at["agrees"], 100).otherwise(90) if ai else F.lit(75)
    return F.struct(
        category_rank(category).alias("rank"), (-confidence).alias("minus"), order.alias("ord"), category.alias("field_name"), at["exact"].alias("original_value"), source.alias("source"),
        confidence.cast("int").alias("confidence"), at["count"].alias("occurrences"), verified.alias("verified"), at["context"].alias("context"), level.alias("sensitivity"), reason.alias("reason"),
    )


_NO_SUGGESTIONS = "array<struct<ai_seq:int,field_name:string,value:string,reason:string,level:string>>"


def findings_array(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, suggested) → doc_id, text and findings, sorted by category, confidence and order."""
    long = F.filter(F.coalesce("suggested", F.array().cast(_NO_SUGGESTIONS)), lambda s: F.length(s["value"]) >= 2)
    keyed = F.transform(long, lambda s: s.withField("key", norm(s["value"])))
    given = first_of_each(keyed, lambda all_: F.transform(all_, lambda s: s["key"]))
    parts = docs.select("doc_id", "text", distinct_hits(F.col("text")).alias("hits"), given.alias("given"))
    at = parts.withColumn("at", located_all(F.col("text"), F.col("hits"), F.col("given")))
    ai = F.transform("given", lambda s, i: _finding(s, F.get("at.given", i), i, True))
    extra = F.filter(F.transform("hits", lambda h, i: F.struct(h.alias("h"), F.get("at.hits", i).alias("at"), (i + 1_000_000_000).alias("ord"))), lambda x: x["at"]["alone"])
    merged = F.sort_array(F.concat(ai, F.transform(extra, lambda x: _finding(x["h"], x["at"], x["ord"], False))))
    return at.select("doc_id", "text", merged.alias("findings"))


def explode_findings(found: DataFrame) -> DataFrame:
    """One row a finding: doc_id, position (from 1), field_id and the finding's columns.

    The number in a field's id is its place among those of its name: places sorted by name, less where the name begins.
    """

    def numbers(order: Column) -> Column:
        begins = F.filter(F.transform(order, lambda x, j: F.struct(x["name"].alias("name"), j.alias("j"))), lambda x: (x["j"] == 0) | ~F.get(order, x["j"] - 1)["name"].eqNullSafe(x["name"]))
        return let(F.map_from_entries(begins), lambda at: F.sort_array(F.transform(order, lambda x, j: F.struct(x["i"].alias("i"), (j - at[x["name"]] + 1).alias("n")))))

    def named(all_: Column) -> Column:
        order = F.sort_array(F.transform(all_, lambda f, i: F.struct(F.coalesce(f["field_name"], F.lit("")).alias("name"), i.alias("i"))))
        return let(let(order, numbers), lambda ns: F.transform(all_, lambda f, i: F.struct((i + 1).cast("long").alias("position"), F.concat_ws("_", slug(f["field_name"]), F.get(ns, i)["n"]).alias("field_id"), f.alias("f"))))

    columns = ("field_name", "original_value", "source", "confidence", "occurrences", "verified", "context", "sensitivity", "reason")
    return found.select("doc_id", F.inline(let(F.col("findings"), named))).select("doc_id", "position", "field_id", *[F.col(f"f.{c}").alias(c) for c in columns])


def reconcile(docs: DataFrame, suggestions: DataFrame) -> DataFrame:
    """docs(doc_id, text), suggestions(doc_id, ai_seq, field_name, original_value, reason, sensitivity) → findings."""
    return explode_findings(findings_array(docs.select("doc_id", "text").join(group_suggestions(suggestions), "doc_id", "left")))
