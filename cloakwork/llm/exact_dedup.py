"""Exact dedup with a cuckoo-filter index of live digests.

The digest of a row is the SHA-256 of its text with every run of white space replaced by one space. Digests are counted
map-side first, so a text that a third of all rows share reaches its bucket as one row from each task. A bucket holds
the stored keys and a cuckoo filter over them: a digest that the filter has not seen is inserted unchecked, a hit is
verified against the bucket's stored keys, and a full filter is rebuilt at twice the size from them. The index is a
table of one row for each live digest; update_index() inserts and deletes. A digest whose best row was deleted while
copies of it live on is stale: it names no row until it is worked out anew from the live rows.

Null text counts as empty; rows that repeat a doc_id and text are rows of their own, of which the first written stays;
a null doc_id sorts after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import SPACE, columns_of, free_name, materialize, quoted, with_ids
from cloakwork.llm.memory import map_pandas

SLOTS = 4
MAX_KICKS = 200
INDEX_SCHEMA = "digest binary, best long, best_row long, n long, stale boolean"
#: Stands for the doc_id of a row without one, and for the best row of a stale digest.
NO_ID = 2**63 - 1


class CuckooFilter:
    """Partial-key cuckoo filter of 16-bit fingerprints, four to a bucket; it can delete, and says when it is full."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(3, int(capacity / (SLOTS * 0.9)).bit_length())
        self.table = [[] for _ in range(self.buckets)]
        self.turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") % self.buckets
        return print_, first, self._other(first, print_)

    def _other(self, place: int, print_: int) -> int:
        return (place ^ (print_ * 0x5BD1E995)) % self.buckets

    def __contains__(self, digest: bytes) -> bool:
        print_, a, b = self._places(digest)
        return print_ in self.table[a] or print_ in self.table[b]

    def insert(self, digest: bytes) -> bool:
        """False where no room was found; the filter then misses one fingerprint and must be rebuilt."""
        print_, a, b = self._places(digest)
        for place in (a, b):
            if len(self.table[place]) < SLOTS:
                self.table[place].append(print_)
                return True
        place = a
        for _ in range(MAX_KICKS):
            self.turn = (self.turn + 1) % SLOTS
            print_, self.table[place][self.turn] = self.table[place][self.turn], print_
            place = self._other(place, print_)
            if len(self.table[place]) < SLOTS:
                self.table[place].append(print_)
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Only for digests that are known to be in: the caller checks its stored keys."""
        print_, a, b = self._places(digest)
        for place in (a, b):
            if print_ in self.table[place]:
                self.table[place].remove(print_)
                return True
        return False


class Bucket:
    """One bucket of the index: stored keys with their best row, count and staleness, and the filter in front of them."""

    def __init__(self, capacity: int = 1024):
        self.keys: dict[bytes, tuple[int, int, int, bool]] = {}
        self.filter = CuckooFilter(capacity)
        self.resizes = 0

    def add(self, digest: bytes, best: int, row: int, n: int, stale: bool = False) -> None:
        if digest in self.filter and (known := self.keys.get(digest)):  # a hit, verified by its stored key
            unknown = stale or known[3]
            self.keys[digest] = (*((NO_ID, NO_ID) if unknown else min(known[:2], (best, row))), known[2] + n, unknown)
            return
        self.keys[digest] = (best, row, n, stale)
        if not self.filter.insert(digest):
            self.resize()

    def remove(self, digest: bytes, best: int, row: int, n: int) -> None:
        """n live rows go, of which (best, row) is the first."""
        if digest not in self.filter or not (known := self.keys.get(digest)):
            return
        if known[2] <= n:
            del self.keys[digest]
            self.filter.delete(digest)
        elif known[3] or (best, row) <= known[:2]:
            self.keys[digest] = (NO_ID, NO_ID, known[2] - n, True)
        else:
            self.keys[digest] = (*known[:2], known[2] - n, False)

    def resize(self) -> None:
        """Twice the room, or more, filled from the stored keys."""
        room = self.filter.buckets * SLOTS
        while True:
            room *= 2
            self.resizes += 1
            self.filter = CuckooFilter(room)
            if all(map(self.filter.insert, self.keys)):
                return


def digest_of(text: Column) -> Column:
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), "UTF-8"), 256)


def _order_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _index_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bucket = Bucket()
    for pdf in batches:
        for digest, best, row, n, stale, op in zip(pdf["digest"], *(pdf[c].tolist() for c in ("best", "best_row", "n", "stale", "op"))):
            if op > 0:
                bucket.add(bytes(digest), best, row, n, stale)
            else:
                bucket.remove(bytes(digest), best, row, n)
    keys = list(bucket.keys)
    for i in range(0, len(keys), 20_000):
        part = keys[i : i + 20_000]
        best, row, n, stale = zip(*(bucket.keys[k] for k in part))
        yield pd.DataFrame({"digest": part, "best": best, "best_row": row, "n": n, "stale": stale})


def _counted(digests: DataFrame) -> DataFrame:
    """Rows of equal digest in one input partition become one row; nothing is shuffled for it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def merged() -> pd.DataFrame:
            pdf = pd.concat(held).sort_values(["best", "best_row"], kind="stable")
            return pdf.groupby("digest", sort=False, as_index=False).agg({"best": "first", "best_row": "first", "n": "sum"})[["digest", "best", "best_row", "n"]].assign(stale=False)

        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= 200_000:
                yield merged()
                held.clear()
        if held:
            yield merged()

    return digests.select("digest", _order_id().alias("best"), F.col("row").alias("best_row"), F.lit(1).cast("long").alias("n")).transform(map_pandas, count, INDEX_SCHEMA)


def build_index(digests: DataFrame) -> DataFrame:
    """digests(digest binary, doc_id, row) → the index: digest, best (doc_id), best_row, n, stale; one row a live digest."""
    return _counted(digests).withColumn("op", F.lit(1)).repartition("digest").transform(map_pandas, _index_partition, INDEX_SCHEMA)


def update_index(index: DataFrame, inserts: DataFrame | None = None, deletes: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """The index after insertion and deletion of rows; each of inserts, deletes and live has digest, doc_id and row.

    A deletion of a digest that isn't live is ignored. Where a digest's best row is deleted and copies are left, its best
    is worked out from live, the rows that are left, if that is given; else it is stale and stays so.
    """
    parts = index.withColumn("op", F.lit(1)).withColumn("turn", F.lit(0))
    for turn, (rows, op) in enumerate(((inserts, 1), (deletes, -1)), 1):
        if rows is not None:
            parts = parts.unionByName(_counted(rows).withColumn("op", F.lit(op)).withColumn("turn", F.lit(turn)))
    updated = parts.repartition("digest").sortWithinPartitions("turn").drop("turn").transform(map_pandas, _index_partition, INDEX_SCHEMA)
    if live is None:
        return updated
    updated = materialize(updated, "dedup-index")
    lost = updated.where("stale").select("digest")
    firsts = live.join(lost, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct(_order_id().alias("id"), "row")).alias("first"))
    known = F.col("first").isNotNull()
    return updated.join(firsts, "digest", "left").select(
        "digest", F.when(known, F.col("first.id")).otherwise(F.col("best")).alias("best"), F.when(known, F.col("first.row")).otherwise(F.col("best_row")).alias("best_row"),
        "n", (F.col("stale") & ~known).alias("stale"),
    )


def digests_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(digest_of(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("row"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row."""
    rows = materialize(digests_of(docs), "digests")
    index = build_index(rows).select(F.col("digest").alias("key"), "best", "best_row", "n")
    joined = rows.join(index, rows["digest"] == F.col("key"))  # a hot digest is split by AQE: the index side has one row for it
    keep = F.when(F.col("best") < NO_ID, F.col("best"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat an earlier text; all columns stay, whatever their names.

    The decisions are joined by doc_id and digest; of rows equal in both, one is picked by their other columns.
    """
    decided = materialize(exact_dedup(docs), "dedup-decisions")
    at = free_name(docs, wanted="_digest")
    named = decided.select("doc_id", F.unhex("text_sha256").alias(at), "kept")
    dropped, kept = (named.where(F.col("kept") == k).select("doc_id", at).distinct() for k in (False, True))
    body = docs.withColumn(at, F.unhex(digest_of(F.col("text"))))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(at) == F.col("kept_digest"))
    again = materialize(dropped.join(kept.select(F.col("doc_id").alias("kept_id"), F.col(at).alias("kept_digest")), same, "left_semi"), "dedup-repeats")
    out = with_ids(body, dropped, ["doc_id", at], "left_anti").select(*columns_of(docs))
    if again.isEmpty():
        return out
    whole = F.struct(*columns_of(docs))
    firsts = with_ids(body, again, ["doc_id", at], "left_semi").groupBy("doc_id", quoted(at)).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("doc")).select("doc.*")
    return out.unionByName(firsts)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of its equals."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM t
"""
