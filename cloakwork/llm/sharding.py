"""Sharding by a k-d tree over document metadata.

A node that must hold k shards is cut at the distributed weighted quantile floor(k/2)/k (the weighted median where k is
even) of its widest dimension, until every leaf is one shard of about total/k bytes. Widths are relative to the range of
the whole table. A string dimension is the rank of its values in the order of their bytes, so whole strings count. Equal
values are told apart by doc_id and a row number, so a hot value, or a third of all rows being copies, is cut like any
other range. Only sums over intervals reach the driver; no task sees a whole node.

Null text counts as no bytes; null metadata sorts first; repeated rows are rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.llm.common import materialize, up_to, utf8_length, weighted_cuts

ROW_BYTES = 8
SHARDS = 24
#: Dimensions of the tree, in order of preference where widths tie.
DIMENSIONS = ("source", "lang", "size", "doc_id")


def order_key(column: Column) -> Column:
    """A number, date or flag as a long in the column's order, null first."""
    return F.coalesce(column.cast("long"), F.lit(-(2**62)).cast("long"))


def ranks(docs: DataFrame, column: str) -> DataFrame:
    """value and rank (from 0, without gaps) of each distinct value of a string column; nulls have none.

    Values are dealt to ranges and numbered in each, and the ranges' counts are summed up, so no task sorts all values.
    """
    distinct = docs.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartitionByRange(parts, "value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id())
    dealt = materialize(dealt.select("value", F.shiftright("at", 33).alias("part"), (F.col("at") % F.lit(2**33)).alias("row")), "kd-ranks")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return materialize(dealt.join(starts, "part").select("value", (F.col("start") + F.col("row")).alias("rank")), "kd-ranks")


def metadata(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions as longs d0.. and a row number: all that the tree needs, without texts."""
    kinds = dict(docs.dtypes)
    used = [d for d in dimensions if d == "size" or d in docs.columns]
    body = F.coalesce(F.col("text"), F.lit(""))
    size = utf8_length(F.col("text")) + ROW_BYTES
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), order_key(F.col("doc_id")).alias("tie"), F.monotonically_increasing_id().alias("row"),
        *[size.alias(f"d{i}") if d == "size" else F.col(d).alias(f"s{i}") if kinds[d] == "string" else order_key(F.col(d)).alias(f"d{i}") for i, d in enumerate(used)],
    )
    for i, d in enumerate(used):
        if d != "size" and kinds[d] == "string":
            table = ranks(docs, d).select(F.col("value").alias(f"v{i}"), F.col("rank").alias(f"r{i}"))
            rows = rows.join(table, F.col(f"s{i}") == F.col(f"v{i}"), "left").withColumn(f"d{i}", F.coalesce(f"r{i}", F.lit(-1).cast("long"))).drop(f"s{i}", f"v{i}", f"r{i}")
    return rows


class _Node:
    def __init__(self, shards: int, first: int):
        self.shards, self.first = shards, first
        self.keys: list[str] = []
        self.cut: tuple | None = None
        self.sides: list[_Node] = []

    def choose(self, of_leaf) -> Column:
        """of_leaf(leaf) for the leaf that a row falls in so far."""
        if not self.sides:
            return of_leaf(self)
        return F.when(up_to(self.keys, self.cut), self.sides[0].choose(of_leaf)).otherwise(self.sides[1].choose(of_leaf))

    def open(self) -> list[_Node]:
        return [x for side in self.sides for x in side.open()] if self.sides else [self] if self.shards > 1 else []


def _shard(leaf: _Node) -> Column:
    return F.lit(leaf.first).cast("long")


def grow_tree(rows: DataFrame, shards: int) -> _Node:
    """Cut level by level; a level costs one pass for widths and a few for its cuts, for all its nodes at once."""
    dims = sorted((c for c in rows.columns if c[0] == "d" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    root, whole = _Node(shards, 0), None
    while nodes := root.open():
        at = rows.withColumn("node", root.choose(_shard))
        bounds = at.groupBy("node").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)])
        found = {r["node"]: r for r in bounds.collect()}
        if not found:
            return root
        if whole is None:
            whole = {d: max(1, found[0][f"max_{d}"] - found[0][f"min_{d}"]) for d in dims}
        targets, ranges = {}, {}
        for n in nodes:
            n.keys = [dims[0], "tie", "row"]
            if r := found.get(n.first):
                n.keys[0] = widest = max(dims, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / whole[d])  # noqa: B023
                targets[n.first] = r["bytes"] * (n.shards // 2) / n.shards
                ranges[n.first] = r[f"min_{widest}"], r[f"max_{widest}"], r["rows"]
        widest_value = root.choose(lambda leaf: F.col(leaf.keys[0] if leaf.keys else dims[0]))
        cuts = weighted_cuts(at.withColumn("along", widest_value), "node", ["along", "tie", "row"], "size", targets, ranges)
        for n in nodes:
            n.cut = cuts.get(n.first)
            n.sides = [_Node(n.shards // 2, n.first), _Node(n.shards - n.shards // 2, n.first + n.shards // 2)]
    return root


def kd_shards(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in its shard) for every row.

    Slots come from two counts: rows by (shard, part of the written table), summed up over the parts, and a row number
    inside each such pair, so no task numbers a whole shard.
    """
    rows = materialize(metadata(docs, dimensions), "kd-rows")
    placed = rows.select("doc_id", "size", "text_crc32", "row", F.shiftright("row", 33).alias("part"), grow_tree(rows, shards).choose(_shard).cast("int").alias("shard"))
    sums = placed.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return placed.withColumn("within", within).join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"))


def op1_kd_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    out = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
