"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbours and pairs with one word between, hashed to 2**BITS
coordinates. Learning goes over a bounded sample of labelled rows, PASSES times, with a rate of its own for every
coordinate; L1 leaves few weights, which are broadcast. The rows' coordinates are worked out where the rows are, and only
they go to the one task that learns, at most MOST_COORDINATES of them. A score counts every word of the whole text.

Null and empty texts have only the bias; rows whose label is null aren't learned from; a doc_id with several labels
takes the largest; without labels of both kinds hardly more than the bias is learned, so every score is near the one label
(0.5 without any); repeated rows are rows of their own, and where one document in very many rows has more coordinates than
the bound, part of its rows are learned from (none, if one alone has more); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.llm.common import materialize
from cloakwork.llm.language_id import held_out
from cloakwork.llm.memory import map_arrow
from cloakwork.llm.words import forget_powers, mix, slices, text_bytes, word_hashes

BITS = 20
#: At most so many labelled rows are learned from, their whole texts, so many times over; and of those, in the order of a
#: hash of their doc_id, as many as have so many coordinates together (160 MB).
SAMPLE_ROWS, PASSES, MOST_COORDINATES = 20_000, 4, 40_000_000
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1
DECIDE = 0.3
SLICE_BYTES = 1_000_000
_KINDS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


#: ASCII signs part words as spaces do.
_LETTERS = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct coordinates of each row."""
    words, at = word_hashes(_LETTERS[data], offsets)
    shift = np.uint64(64 - BITS)
    one = (mix(words * _KINDS[0]) >> shift).astype(np.int64)
    two = (mix(words[:-1] * _KINDS[1] + words[1:]) >> shift).astype(np.int64)
    skip = (mix(words[:-2] * _KINDS[2] + words[2:]) >> shift).astype(np.int64)
    return [np.unique(np.concatenate((one[a:b], two[a : max(a, b - 1)], skip[a : max(a, b - 2)]))).astype(np.int32) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class Ftrl:
    """Per-coordinate state of FTRL-proximal; coordinate 2**BITS is the bias, which has no L1."""

    def __init__(self) -> None:
        n = (1 << BITS) + 1
        self.z, self.n, self.l1 = np.zeros(n), np.zeros(n), np.full(n, L1)
        self.l1[-1] = 0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1[at], 0.0, -(z - np.sign(z) * self.l1[at]) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with a weight, and the weights. rows: the distinct coordinates of each text."""
    model, order, bias = Ftrl(), np.random.default_rng(7), np.array([1 << BITS], np.int32)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)).tolist():
            model.learn(np.concatenate((rows[i], bias)), labels[i])
    w = model.weights(np.arange((1 << BITS) + 1))
    at = np.flatnonzero(w)
    return at, w[at]


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, toxic, coordinates (packed) and how many, for every row."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in slices(offsets, SLICE_BYTES):
            found = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            own = [batch.column(c).slice(a, b - a) for c in ("h", "toxic")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x.tobytes() for x in found], pa.binary()), pa.array(list(map(len, found)), pa.int64())], names=["h", "toxic", "at", "n"])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights from at most SAMPLE_ROWS labelled rows that aren't held out: those of the least hashes of their doc_id.

    The bound on hashes is set by a count, so that only the sample is joined; that on coordinates by running sums over
    the sample's hashes.
    """
    marked = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    total = marked.count()
    share = min(1.0, 0.97 * SAMPLE_ROWS / max(1, total))
    h = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30))
    least = h < int(share * (1 << 30))
    picked = marked.where(least).limit(SAMPLE_ROWS)
    sample = docs.where(least).select("doc_id", "text", h.alias("h")).join(F.broadcast(picked), "doc_id").select("h", "toxic", "text")
    rows = materialize(sample.transform(map_arrow, _with_features, "h long, toxic int, at binary, n long", then=forget_powers), "toxic-features")
    sums = rows.groupBy("h").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("h")))
    end = sums.where(F.col("upto") <= MOST_COORDINATES).agg(F.max("h")).first()[0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "at"])
        at, w = fit([np.frombuffer(x, np.int32) for x in pdf["at"]], pdf["toxic"].tolist())
        return pd.DataFrame({"at": at, "w": w})

    if end is None and (first := rows.groupBy("h").agg(F.max("n").alias("n")).orderBy("h").first()):  # one document in very many rows
        sample = rows.where(F.col("h") == first["h"]).orderBy("n", "at").limit(MOST_COORDINATES // max(1, first["n"]))
    else:
        sample = rows.where(F.col("h") <= (-1 if end is None else end))
    found = sample.withColumn("model", F.lit(0)).groupBy("model").applyInPandas(run, "at long, w double").toPandas()
    return found["at"].to_numpy(), found["w"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted for every row. The model is broadcast: at most 2**BITS + 1 weights."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << BITS) + 1, np.float32)
        weights[sent.value[0]] = sent.value[1]
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, SLICE_BYTES):
                sums = [float(weights[x].sum()) for x in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                out = 1 / (1 + np.exp(-np.clip(np.array(sums) + float(weights[-1]), -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, "doc_id long, score double", then=forget_powers)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= DECIDE).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels.toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
