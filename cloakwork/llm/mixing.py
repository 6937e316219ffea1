"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u)/quality, where u is a hash of its doc_id and a seed. A source whose target
is e times its size and a bit takes e complete epochs and then, in the order of keys, the documents whose prefix sum of
words comes nearest to the rest. In small sources that is a running sum; in a source of more than WINDOW_ROWS rows, or
more than a share of 1 / MOST_WIDE of all rows, it is searched by interval sums (common.weighted_cuts), so a source with
a third of all rows is never sorted in one task. Whole documents are taken. One row a source goes through one task, for
the targets; at most MOST_WIDE records reach the driver, however many sources there are.

Null text has no words; a null source is a source of its own, last in order; rows that share a doc_id and a quality have
one key, and are taken together if they share a source; rows that share a doc_id only are rows of their own. Documents
without words are taken in no fraction; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.llm.common import columns_of, materialize, values, weighted_cuts, words_of

#: Weights of the sources in their order, repeating; a source is taken at most MAX_EPOCHS times.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20
WINDOW_ROWS, MOST_WIDE = 4_096, 10_000
_SCALE = 2**40


def quality_weight(text: Column) -> Column:
    """A weight in (0, 1] that is 1 where words have six characters on average and falls off on both sides."""
    n = words_of(text)
    mean = F.length(text) / n
    return F.when(n > 0, 1 / (1 + F.abs(mean - 6) / 6)).otherwise(F.lit(1.0))


def es_key(doc_id: Column, quality: Column, seed: int = SEED) -> Column:
    """Efraimidis-Spirakis: an exponential variable of rate quality, as a long; the smallest keys are taken first."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + 0.5) / float(2**53)
    return F.floor(-F.log(u) / F.greatest(quality, F.lit(1e-3)) * _SCALE).cast("long")


def targets_of(sources: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """target for each source: share of all words by weight, at most `most` times its size, the excess given to the rest.

    Closed form of the repeated resharing: in the order of cap/weight, a source is capped while the level
    (words left)/(weights left) exceeds cap/weight; all later ones get level * weight. One row for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ratio = Window.orderBy("ratio", "rank")
    earlier = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sources.withColumn("rank", F.row_number().over(order) - 1)
    t = t.withColumn("w", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", (F.col("source_size") * most).cast("double"))
    t = t.withColumn("ratio", F.col("cap") / F.col("w"))
    left_words = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    left_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    t = t.withColumn("level", left_words / left_weight)
    open_from = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)
    capped = F.col("from").isNull() | (F.struct("ratio", "rank") < F.struct(F.col("from.ratio"), F.col("from.rank")))
    return t.withColumn("from", open_from).select(*sources.columns, "rank", F.when(capped, F.col("cap")).otherwise(F.col("from.level") * F.col("w")).alias("target"))


def _tie() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62)).cast("long"))


def _measures(quality: Column | None) -> list[Column]:
    """What a row's text, source and doc_id give: source, size, key and tie."""
    key = es_key(F.col("doc_id"), quality_weight(F.col("text")) if quality is None else quality)
    return [F.col("source").alias("source"), words_of(F.col("text")).alias("size"), key.alias("key"), _tie().alias("tie")]


def measured(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """doc_id, source, size, key and tie of every row. quality: the weight of a document, quality_weight() if None."""
    return docs.select("doc_id", *_measures(quality))


def _small_cuts(rows: DataFrame) -> DataFrame:
    """rank, cut_key, cut_tie: the last row of the prefix nearest to rest, of sources small enough for a running sum."""
    upto = F.sum("w").over(Window.partitionBy("rank").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy("rank", "key", "tie").agg(F.sum("size").alias("w"), F.max("rest").alias("rest"))
    off = sums.withColumn("off", F.abs(upto - F.col("rest")))
    best = off.groupBy("rank").agg(F.min(F.struct("off", "key", "tie")).alias("best"), F.max("rest").alias("rest"))
    return best.where("best.off <= rest").select("rank", F.col("best.key").alias("cut_key"), F.col("best.tie").alias("cut_tie"))


def plan(rows: DataFrame) -> DataFrame:
    """source, source_size, target, epochs and the cut (key, tie) up to which one more copy is taken. One row a source."""
    spark = rows.sparkSession
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)).cast("int")
    targets = targets_of(sources).withColumn("epochs", full).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    targets = materialize(targets, "mix-targets")
    small = max(WINDOW_ROWS, (targets.agg(F.sum("n")).first()[0] or 0) // MOST_WIDE)
    open_ = targets.where("rest > 0 AND source_size > 0").select(F.col("source").alias("s"), F.col("rank").cast("long").alias("rank"), "rest", "n")
    ranked = rows.where("size > 0").join(open_, F.col("source").eqNullSafe(F.col("s"))).select("rank", "key", "tie", "size", "rest", "n")
    wide = {r["rank"]: r["rest"] for r in open_.where(F.col("n") > small).select("rank", "rest").collect()}
    cuts = weighted_cuts(ranked.where(F.col("n") > small), "rank", ["key", "tie"], "size", wide, in_one_task=small)
    table = _small_cuts(ranked.where(F.col("n") <= small)).unionByName(values(spark, [(g, *c) for g, c in cuts.items() if c], "rank long, cut_key long, cut_tie long"))
    planned = targets.join(table, "rank", "left").select(F.col("source").alias("of_source"), "source_size", "target", "epochs", "cut_key", "cut_tie")
    return materialize(planned, "mix-plan")


def copies() -> Column:
    """How often a row of measured() joined with plan() is taken."""
    before = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("tie") <= F.col("cut_tie")))
    return F.col("epochs") + F.when((F.col("size") > 0) & F.coalesce(before, F.lit(False)), 1).otherwise(0)


def mix(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) for every row."""
    rows = materialize(measured(docs, quality), "mix-rows")
    joined = rows.join(plan(rows), F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns. Texts aren't shuffled by a small plan."""
    rows = materialize(measured(docs, quality), "mix-rows")
    body = docs.select(F.struct(*columns_of(docs)).alias("doc"), *_measures(quality))
    joined = body.join(plan(rows), F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select("doc", F.explode(F.array_repeat(F.lit(1), copies().cast("int"))).alias("copy")).select("doc.*")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents at 100 % of their words."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
