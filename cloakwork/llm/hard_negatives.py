"""Hard negatives for contrastive training, by a vector-approximation file.

Every component of every vector is quantised into one of CELLS cells of its dimension, one byte. The cells' inner edges
are quantiles of a bounded sample of rows, the outer ones the least and greatest component of all rows, so each code
gives an interval that holds the component. Beside the codes the file has the vectors themselves, in the narrowest
integers that hold them, and rows lie in it by a hash.

Anchors are a stated query set: they go through in blocks of BLOCK_BYTES, each block against all rows, in two passes.
For an anchor, a table says what each cell of each dimension adds to the least and the greatest possible score; a row's
bounds are sums over looked-up entries (one complex number carries both). In the first pass a row of the anchor's label
is scored exactly only if its upper bound reaches the n-th best lower bound so far; in the second, a row of another label
only if its bounds may put it into a positive's window, above what the window already has. A task holds the few best rows
of each anchor, and those of all tasks are ranked by Spark. Bounds never exclude a row that belongs to the result, so it
is exact, whatever the sample.

A null vec_id, label or vector, or any null or non-finite component, takes a row out. Rows that share a vec_id are rows
of their own, and each is an anchor, positive or negative of its own. Of different lengths, the shorter vector is filled
up with zeros. Scores beyond 64 bits count as the greatest or least long. Anchors without positives, and positives
without negatives in their window, have no rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.llm.common import materialize, shared_dir
from cloakwork.llm.memory import map_arrow

CELLS = 64
#: The cells' inner edges come from at most so many rows, the first by a hash of their ids.
SAMPLE_ROWS = 10_000
#: Anchors of a block, as doubles; so much goes to every task with the pass over all rows.
BLOCK_BYTES = 2 << 20
#: So many rows of the file are meant for one task.
TASK_ROWS = 100_000
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 256, 1024
EXACT = 2.0**53
FOUND = "anchor int, place int, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Cells:
    """edges[d]: the CELLS + 1 edges of the cells of dimension d, in ascending order; kind: how vectors are stored."""

    edges: np.ndarray
    kind: str

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(vectors.shape, np.uint8)
        for d, edges in enumerate(self.edges):
            out[:, d] = np.searchsorted(edges[1:-1], vectors[:, d], "right")
        return out

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """dimension x cell x anchor: the least (real) and greatest (imaginary) product of a component in the cell."""
        ends = self.edges[:, :, None] * anchors.T[:, None, :]
        low, high = ends[:, :-1], ends[:, 1:]
        out = np.minimum(low, high) + 1j * np.maximum(low, high)
        whole = np.abs(ends).max(axis=1, initial=0).sum(axis=0)  # sums under EXACT are whole numbers and exact
        slack = np.where(whole < EXACT, 0, whole * 2.0**-40)
        if len(out) and slack.any():
            out[0] += slack * (1j - 1)
        return out


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of dims doubles, filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, within 64 bits."""
    most = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())]
    return np.array([min(max(s, _LONG.min + 1), _LONG.max) for s in whole], np.int64)


def first_of_each(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Where the first `most` of every key are, by score from above, then by id."""
    order = np.lexsort((ids, -scores, keys))
    sorted_keys = keys[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_keys, sorted_keys) < most]


class Best:
    """The best rows of each key so far, and the least score that can still enter."""

    def __init__(self, n_keys: int, most: int):
        self.most, self.keys, self.scores, self.ids = most, *(np.zeros(0, np.int64) for _ in range(3))
        self.enters = np.full(n_keys, _LONG.min, np.int64)

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keys, scores, ids = (np.concatenate(x) for x in ((self.keys, keys), (self.scores, scores), (self.ids, ids)))
        kept = first_of_each(keys, scores, ids, self.most)
        self.keys, self.scores, self.ids = keys[kept], scores[kept], ids[kept]
        full = np.bincount(self.keys, minlength=len(self.enters)) == self.most
        last = np.full(len(self.enters), _LONG.max, np.int64)
        np.minimum.at(last, self.keys, self.scores)
        self.enters[full] = last[full]

    def batch(self, places: int) -> pa.RecordBatch:
        columns = (pa.array(self.keys // places, pa.int32()), pa.array(self.keys % places, pa.int32()), pa.array(self.ids), pa.array(self.scores))
        return pa.RecordBatch.from_arrays(list(columns), names=["anchor", "place", "vec_id", "score"])


@dataclass(frozen=True)
class Block:
    """Anchors of one pass, in a fixed order; windows: low and high of each anchor and positive, empty ones with low > high."""

    rows: np.ndarray
    vec_ids: np.ndarray
    labels: pa.Array
    vectors: np.ndarray
    windows: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.rows)


def _read(batch: pa.RecordBatch, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, vec_id, codes and stored vectors of a batch of the file."""
    n, dims = batch.num_rows, len(cells.edges)
    joined = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, dims)
    return batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), joined("codes", np.uint8), joined("body", cells.kind)


def bounds(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """row x anchor: least and greatest possible score, as one complex number."""
    out = np.zeros((len(codes), tables.shape[2]), np.complex128)
    for d in range(codes.shape[1]):
        out += tables[d][codes[:, d]]
    return out


def _pieces(cells: Cells, block: Block, codes: np.ndarray, rows: np.ndarray, anchors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, rows and their bounds, in pieces of bounded size."""
    for i in range(0, len(anchors), ANCHORS_AT_ONCE):
        some = anchors[i : i + ANCHORS_AT_ONCE]
        tables = cells.tables(block.vectors[some])
        for j in range(0, len(rows), ROWS_AT_ONCE):
            part = rows[j : j + ROWS_AT_ONCE]
            yield some, part, bounds(tables, codes[part])


def _positives_task(cells: Cells, block: Block, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block), most)
        names = block.labels.unique()
        own = pc.index_in(block.labels, value_set=names).to_numpy()
        for batch in batches:
            row, vec_id, codes, body = _read(batch, cells)
            label = pc.fill_null(pc.index_in(batch.column("label"), value_set=names), -1).to_numpy()
            for k in np.unique(label[label >= 0]).tolist():
                for some, part, bound in _pieces(cells, block, codes, np.flatnonzero(label == k), np.flatnonzero(own == k)):
                    itself = row[part][:, None] == block.rows[some]
                    low, enters = np.where(itself, -np.inf, bound.real), best.enters[some].astype(np.float64)
                    if len(part) >= most:
                        enters = np.maximum(enters, np.partition(low, len(part) - most, axis=0)[len(part) - most])
                    at, who = np.nonzero(~itself & (bound.imag >= enters))
                    best.add(some[who], inner_products(body[part[at]].astype(np.float64), block.vectors[some[who]]), vec_id[part[at]])
        yield best.batch(1)

    return run


def _negatives_task(cells: Cells, block: Block, places: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block) * places, most)
        names = block.labels.unique()
        own = pc.index_in(block.labels, value_set=names).to_numpy()
        low, high = block.windows[:, :, 0], block.windows[:, :, 1]
        wanted = np.flatnonzero((low <= high).any(axis=1))
        for batch in batches:
            row, vec_id, codes, body = _read(batch, cells)
            label = pc.fill_null(pc.index_in(batch.column("label"), value_set=names), -1).to_numpy()
            for some, part, bound in _pieces(cells, block, codes, np.arange(len(row)), wanted):
                enters = np.maximum(low[some], best.enters.reshape(-1, places)[some])
                enters = np.where(enters <= high[some], enters, _LONG.max)
                may = (bound.imag >= enters.min(axis=1).astype(np.float64)) & (bound.real <= high[some].max(axis=1).astype(np.float64))
                at, who = np.nonzero(may & (label[part][:, None] != own[some]))
                scores = inner_products(body[part[at]].astype(np.float64), block.vectors[some[who]])
                inside, place = np.nonzero((scores[:, None] >= enters[who]) & (scores[:, None] <= high[some][who]))
                best.add(some[who[inside]] * places + place, scores[inside], vec_id[part[at[inside]]])
        yield best.batch(places)

    return run


def learned_cells(rows: DataFrame) -> Cells | None:
    """Cells of the components of rows(vec_id, vector); None without rows."""
    extent = rows.select(F.posexplode_outer("vector").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    if not extent:
        return None
    extent = sorted(((r["d"], r["low"], r["high"]) for r in extent if r["d"] is not None))
    dims = len(extent)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow().column("vector").combine_chunks()
    inner = np.quantile(vectors_of(sample, dims), np.arange(1, CELLS) / CELLS, axis=0).T
    # a shorter vector's missing components are zeros
    ends = np.array([(min(low, 0.0), max(high, 0.0)) for _, low, high in extent]).reshape(dims, 2)
    edges = np.concatenate((ends[:, :1], np.clip(inner, ends[:, :1], ends[:, 1:]), ends[:, 1:]), axis=1)
    widest = np.abs(ends).max(initial=0)
    return Cells(edges, next((k for k, most in (("<i2", 2**15), ("<i4", 2**31)) if widest < most), "<f8"))


def approximation_file(rows: DataFrame, cells: Cells, n_rows: int) -> DataFrame:
    """rows(vec_id, label, anchor, vector) → the written file: row, vec_id, label, anchor, codes, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
        for batch in batches:
            vectors = vectors_of(batch.column("vector"), len(cells.edges))
            columns = [*(batch.column(c) for c in ("row", "vec_id", "label", "anchor")), binary(cells.codes(vectors)), binary(vectors.astype(cells.kind))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "label", "anchor", "codes", "body"])

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", "vector")
    made = numbered.transform(map_arrow, run, "row long, vec_id long, label string, anchor boolean, codes binary, body binary")
    return materialize(made.repartition(parts, "row"), "va-file")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """vectors(vec_id, label, vector of whole numbers) → RESULT: for each anchor and each of its best rows of the same
    label, the best rows of other labels whose score is `least` to `most` percent of the positive's."""
    spark = vectors.sparkSession
    vector = F.col("vector").cast("array<double>")
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite
    rows = vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), vector.alias("vector"))
    cells = learned_cells(rows)
    if cells is None:
        return spark.createDataFrame([], RESULT)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    file = approximation_file(rows, cells, sizes["n"])
    dims = len(cells.edges)
    blocks = -(-2 * sizes["anchors"] * 8 * max(dims, 1) // BLOCK_BYTES)  # by a hash, half full on average
    path = f"{shared_dir(spark)}/hard-negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], RESULT).write.parquet(path)
    ranked = lambda found, n: found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= n)
    for b in range(blocks):
        got = file.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).orderBy("row").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        bodies = np.frombuffer(b"".join(got.column("body").to_pylist()), cells.kind).reshape(-1, dims).astype(np.float64)
        block = Block(got.column("row").to_numpy(), got.column("vec_id").to_numpy(), got.column("label").combine_chunks(), bodies)
        near = ranked(file.select("row", "vec_id", "label", "codes", "body").transform(map_arrow, _positives_task(cells, block, positives), FOUND), positives).collect()
        windows = np.empty((len(block), positives, 2), np.int64)
        windows[:] = (1, 0)
        for r in near:
            low, high = -(-least * r["score"] // 100), most * r["score"] // 100
            if low <= high:
                windows[r["anchor"], r["rank"] - 1] = (max(low, _LONG.min + 1), min(high, _LONG.max))
        block = Block(block.rows, block.vec_ids, block.labels, block.vectors, windows)
        far = ranked(file.select("row", "vec_id", "label", "codes", "body").transform(map_arrow, _negatives_task(cells, block, positives, negatives), FOUND), negatives)
        pairs = [(r["anchor"], r["rank"] - 1, int(block.vec_ids[r["anchor"]]), r["vec_id"], r["score"]) for r in near]
        known = spark.createDataFrame(pairs, "anchor int, place int, anchor_id long, positive_id long, positive_score long")
        joined = far.join(F.broadcast(known), ["anchor", "place"])  # as many rows as a block has anchors, times positives
        joined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors are every hundredth vector; every seventh has a wrong label, components are 256ths."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    floor = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  # beyond, doubles are whole
    scaled = F.transform("embedding", lambda x: floor(256 * x.cast("double")))
    whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = table.where(whole).select("vec_id", label.alias("label"), scaled.alias("vector"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k FROM scored WHERE same
  QUALIFY k <= 5
), negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY n.score DESC, n.vec_id) AS rank,
         n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
