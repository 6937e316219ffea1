"""How five filters of documents act together, in every order, by inclusion and exclusion.

One pass over the texts gives each row its failures, and one aggregation adds up, for each part and each of the 32 sets
of filters, the rows that fail all of the set: the sums of the products of their flags. All else follows from these
joint counts J, a few numbers a part, whatever the corpus has:

* survivors of a set S: the sum over T in S of (-1)^|T| J(T) (Möbius inversion);
* removed by a filter after a prefix of an order: survivors of the prefix less those of the prefix with it;
* redundant: J of the filter alone less what it removes; unique failures: survivors of the other four less those of all;
* Shapley value of a filter in the game "rows removed": the sum of the Harsanyi dividends (-1)^(|T|+1) J(T) of the sets
  T with it, each shared among |T|; times 120 that is a whole number, and the sum over all orders of what it removes.

Filter E asks whether a text stood in a row of a smaller doc_id. Texts are named by their SHA-256; a digest's least
doc_id is aggregated before the shuffle and goes back to the rows by doc_id and digest, not by the digest alone, so a
text that a third of all rows share makes no large task.

A null text is an empty one and fails A; a null doc_id is no smaller id and has none, so its row passes E; rows that
share the smallest doc_id of a text all pass E. Several labels of a document count as one that says yes if any does; a
null label says no, and labels of no document are left out. A null lang is the part "", with rows whose lang is "". An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import SPACE

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: What is counted of the rows of each set: all, and those with either label.
KINDS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D: too few words, too few different ones, too many capitals, signs of markup."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: fails the i-th filter), good and toxic of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(text).values())), F.lit(0)).alias("mask"),
    )
    firsts = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    known = rows.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    return known.select("part", (F.col("mask") + F.when(repeated, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), *[F.coalesce(k, F.lit(False)).alias(k) for k in KINDS[1:]])


def joint_counts(rows: DataFrame) -> DataFrame:
    """part, and for each kind an array of 32: at S, the rows that fail every filter of S."""
    flags = rows.select("part", *[F.expr(f"(mask >> {i}) & 1").alias(c) for i, c in enumerate(FILTERS)], F.lit(1).alias("n"), *[F.col(k).cast("int").alias(k) for k in KINDS[1:]])
    product = lambda kind, s: " * ".join([kind, *(c for i, c in enumerate(FILTERS) if s >> i & 1)])
    return flags.groupBy("part").agg(*[F.expr(f"array({', '.join(f'sum({product(k, s)})' for s in range(ALL + 1))})").alias(k) for k in KINDS])


def _signed(joint: str, within: int, holding: int = 0) -> str:
    """SQL for the sum of (-1)^|T| J(T) over the sets T in `within` that have all of `holding`."""
    return " ".join(f"{'-' if t.bit_count() % 2 else '+'} {joint}[{t}]" for t in range(ALL + 1) if t & within == t and t & holding == holding)


def audit(joint: DataFrame) -> DataFrame:
    """joint_counts() → part, filter_order, step and what the filter of that step does there; 600 rows a part."""
    array = lambda values, name: F.expr(f"array({', '.join(values)})").alias(name)
    singles = [1 << i for i in range(len(FILTERS))]
    share = factorial(len(FILTERS))
    dividends = lambda f: " ".join(f"{'+' if t.bit_count() % 2 else '-'} {share // t.bit_count()} * n[{t}]" for t in range(1, ALL + 1) if t & f)
    values = joint.select(
        "part", *[array([_signed(k, s) for s in range(ALL + 1)], f"{k}_left") for k in KINDS], array([f"n[{f}]" for f in singles], "fails"),
        array([f"-({_signed('n', ALL, f)})" for f in singles], "unique_all"), array(map(dividends, singles), "shapley_all"),
    )
    orders = F.array(*map(F.lit, map("".join, permutations(FILTERS))))
    steps = values.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda c: F.instr("filter_order", c)
    before = sum((F.when(place(c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))
    own = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    at = steps.withColumn("before", before).withColumn("own", own).withColumn("upto", F.col("before") + F.pow(F.lit(2), F.col("own")).cast("int"))
    lost = lambda k: F.col(f"{k}_left")[F.col("before")] - F.col(f"{k}_left")[F.col("upto")]
    return at.select(
        "part", "filter_order", "step", F.col("n_left")[F.col("upto")].alias("kept"), lost("n").alias("removed"), (F.col("fails")[F.col("own")] - lost("n")).alias("redundant"),
        F.col("unique_all")[F.col("own")].alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("shapley_all")[F.col("own")].alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(joint_counts(failures(docs, labels)))


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents
), w AS (
  SELECT doc_id, part, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS first_id FROM t
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
          100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 10 * length(body),
          regexp_matches(body, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] AS fails
  FROM w LEFT JOIN marks USING (doc_id)
), seen AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || c FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(filter_order, c)
), steps AS (
  SELECT filter_order, step, [position(c IN 'ABCDE') FOR c IN string_split(filter_order[1:step - 1], '') IF c <> ''] AS before, position(filter_order[step] IN 'ABCDE') AS own
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5
), acts AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS here, len([x FOR x IN before IF fails[x]]) > 0 AS gone, len([x FOR x IN fails IF x]) AS failed
  FROM seen, steps
), counts AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost
  FROM acts GROUP BY ALL
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counts
"""
