"""Quality by importance resampling.

Two generative models over hashed word n-grams (words and pairs of neighbours, BUCKETS of them) are counted: of target
text, which a label marks as good, and of all raw text. log_ratio is the log of the ratio of a text's probabilities under
the two, the sum over its n-grams. Drawing by it would follow length: n-grams of one text aren't independent, and the sum
of a long text outgrows any noise. So the log weight that is drawn by is the mean over the n-grams times EVIDENCE.
Gumbel noise drawn from a hash of doc_id is added to the log weight, and the KEEP share of rows with the largest sums is
a sample without replacement in proportion to the weights.

The raw model counts every document; the target model those of at most SAMPLE_ROWS labelled rows. Only bucket counts
reach the driver. A null or empty text has no n-gram and log weight 0; a null label isn't learned from; without labels
all log weights are 0; repeated rows are rows of their own, kept or left together where they share a doc_id and text; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import materialize, up_to, weighted_cuts
from cloakwork.llm.language_id import held_out
from cloakwork.llm.memory import map_arrow
from cloakwork.llm.words import forget_powers, mix, slices, text_bytes, word_hashes

BUCKETS = 1 << 14
#: At most so many labelled rows make the target model.
SAMPLE_ROWS = 100_000
EVIDENCE, KEEP, SEED = 200.0, 0.75, 6
SLICE_BYTES = 1_000_000
_SCALE = 2**40
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _ngrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: hashed n-grams, flat, words before pairs in no set order, and the row of each."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, SLICE_BYTES):
        words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        row = np.repeat(np.arange(b - a), np.diff(at))
        one, two = mix(words) % np.uint64(BUCKETS), mix(words[:-1] * _PAIR + words[1:]) % np.uint64(BUCKETS)
        inside = row[1:] == row[:-1]
        yield a, b, np.concatenate((one, two[inside])).astype(np.int64), np.concatenate((row, row[1:][inside]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        for a, b, ngrams, row in _ngrams(batch.column("text")):
            raw += np.bincount(ngrams, minlength=BUCKETS)
            target += np.bincount(ngrams[good[a:b][row]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of the target's and the raw text's probability of each bucket, add-one smoothed.

    Target rows are those labelled good that aren't held out, of the least hashes of their doc_id where there are more
    than SAMPLE_ROWS; that bound makes them small enough to broadcast.
    """
    good = labels.where("quality = 1").select("doc_id").distinct().where(~held_out(F.col("doc_id")))
    share = min(1.0, 0.97 * SAMPLE_ROWS / max(1, good.count()))
    picked = good.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE_ROWS).select(F.col("doc_id").alias("target_id"))
    marked = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("target_id"), "left").select("text", F.col("target_id").isNotNull().alias("good"))
    counts = marked.transform(map_arrow, _count, "bucket int, raw long, target long", then=forget_powers).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_ratio and log_weight for every row. The model is a constant BUCKETS numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ngrams, row in _ngrams(batch.column("text")):
                n = np.bincount(row, minlength=b - a)
                sums = np.bincount(row, sent.value[ngrams], minlength=b - a)
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(sums.astype(np.float64)), pa.array(EVIDENCE * sums / np.maximum(n, 1), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_grams", "log_ratio", "log_weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, "doc_id long, n_grams long, log_ratio double, log_weight double", then=forget_powers)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + 0.5) / float(2**53)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, n_grams, log_ratio, log_weight, gumbel_key and kept for every row; kept: in the top keep * rows by key.

    The last key that is kept is found by interval counts, so rows are never sorted in one task.
    """
    scored = log_weights(docs, learn(docs, labels)).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id")))
    tie = F.coalesce(F.col("doc_id"), F.lit(-(2**62)))
    rows = materialize(scored.withColumns({"place": F.floor(-F.col("gumbel_key") * _SCALE).cast("long"), "tie": tie, "one": F.lit(1).cast("long"), "whole": F.lit(0).cast("long")}), "weights")
    n = rows.count()
    cut = weighted_cuts(rows, "whole", ["place", "tie"], "one", {0: keep * n} if n else {})
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_grams", "log_ratio", "log_weight", "gumbel_key", up_to(["place", "tie"], cut.get(0)).alias("kept"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Every document with its weight and whether the resampling keeps it."""
    return resample(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
