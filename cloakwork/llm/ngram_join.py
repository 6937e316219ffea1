"""N-gram Jaccard join of whole texts by a prefix-tree join, and the components of its links.

1. Texts become sets of hashed 5-word shingles; equal sets become one node. Tasks send every shingle, four bytes beside
   its bucket, once for each set; a bucket tells which are in another set too. A set of which less than four fifths are
   so can't have a partner and is left out: this is exact, as truncation can only keep a set.
2. The sets that are left are counted again among themselves and put in the global order, rarest shingle first. Two
   sets that link share a shingle of their prefixes; sets joined by such shingles, near or far, form a block.
3. In a block the sets, most frequent shingle first, go into a prefix tree one by one. Each is first sought in it: the
   walk shares the overlap counted on common paths, and leaves a subtree whose remaining lengths can't reach the
   threshold, or whose sets are all in the seeker's component already. Blocks of over CHUNK sets are cut in chunks of
   about CHUNK; chunks meet in pairs, two in a tree, unless all their sets are in one component by then. Before that one
   set of each component of a chunk goes into trees with those of eight chunks, at most as many sets as eight chunks have.

Shingles and sets are told apart by 64-bit hashes. Null and empty texts have no set and no link; copies, however many,
are one node; rows that repeat a doc_id share a component if their texts link; a null doc_id has a null component unless
another row of its component has an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import columns_of, materialize, with_ids
from cloakwork.llm.components import connected_components
from cloakwork.llm.memory import bound_batches, map_arrow, release
from cloakwork.llm.words import forget_powers, mix, slices, text_bytes, word_hashes

SHINGLE = 5
#: Links need 9 * shared >= 4 * (sum of sizes), which is a Jaccard similarity of 0.8.
SHARED, SIZES = 9, 4
#: A chunk has about CHUNK sets of one block, as a hash deals them; a task collects TASK_SETS sets of small blocks.
CHUNK, TASK_SETS = 1_500, 2_000
SLICE_BYTES, FLUSH = 1_000_000, 1_000_000
#: A task remembers so many sets that it has sent; beyond, a set may be sent again and is dropped where it arrives.
MOST_NAMES = 200_000
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each row, and a 64-bit digest of each set (0 for none)."""
    words, at = word_hashes(data, offsets)
    windows = np.zeros(0, np.uint64)
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        windows = words[:n] * _K[0]
        for k in range(1, SHINGLE):
            windows += words[k : n + k] * _K[k]
        windows = mix(windows)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            sets.append(np.unique(windows[a : b - SHINGLE + 1]))
        elif b > a:
            sets.append(mix(np.array([np.sum(words[a:b] * np.array(_K[: b - a]), dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    digests = mix(np.array([np.sum(mix(s ^ _K[4]), dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64))
    return sets, np.where([len(s) > 0 for s in sets], digests, 0).astype(np.uint64).view(np.int64)


class _Packer:
    """Deals shingles to buckets: for each bucket, sets (digest and count, in order) and their shingles."""

    def __init__(self, buckets: int, width: str):
        self.buckets, self.width = buckets, width
        self.clear()

    def clear(self) -> None:
        self.digests, self.sets, self.size = [], [], 0

    def add(self, digest: int, shingles: np.ndarray) -> None:
        self.digests.append(digest)
        self.sets.append(shingles)
        self.size += len(shingles)

    def flush(self) -> dict[str, list]:
        flat = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets), dtype=np.int32), [len(s) for s in self.sets])
        digests = np.array(self.digests, np.int64)
        bucket = (flat >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        order = np.argsort(bucket.astype(np.uint16 if self.buckets < 65536 else np.uint32), kind="stable")
        flat, owner, bucket = flat[order].astype(self.width), owner[order], bucket[order]
        out: dict[str, list] = {"bucket": [], "digests": [], "counts": [], "shingles": []}
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(flat))
        start = 0
        for end in ends.tolist():
            mine = owner[start:end]
            first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            out["bucket"].append(int(bucket[start]))
            out["digests"].append(digests[mine[first]].tobytes())
            out["counts"].append(np.diff(np.append(first, len(mine))).astype(np.uint32).tobytes())
            out["shingles"].append(flat[start:end].tobytes())
            start = end
        self.clear()
        return out


_PACKED = "bucket int, digests binary, counts binary, shingles binary"


def _batch(schema: pa.Schema, columns: dict[str, list | np.ndarray], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in ddl.split(", ")])


_DOC = "doc_id long, n int, sid long"


def _send_shingles(buckets: int):
    """Rows of documents (doc_id, size and digest of the set), and packed shingles of the sets, dealt to buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(f"{_PACKED}, {_DOC}")
        packer, sent = _Packer(buckets, "<u4"), set()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, SLICE_BYTES):
                sets, digests = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for digest, s in zip(digests.tolist(), sets):
                    if len(s) and digest not in sent:
                        if len(sent) > MOST_NAMES:
                            sent.clear()
                        sent.add(digest)
                        packer.add(digest, s)
                rows = {"bucket": (digests % buckets).astype(np.int32), "doc_id": batch.column("doc_id").slice(a, b - a), "n": np.array([len(s) for s in sets], np.int32), "sid": digests}
                yield _batch(schema, rows, b - a)
                if packer.size >= FLUSH:
                    out = packer.flush()
                    yield _batch(schema, out, len(out["bucket"]))
        if packer.size:
            out = packer.flush()
            yield _batch(schema, out, len(out["bucket"]))

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], width: str, others: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bucket of a partition: digests of its sets, the set of each shingle, and the shingles; one row a set."""
    held: dict[int, tuple[list, list, list]] = {}
    for batch in batches:
        packed = batch.filter(pa.compute.is_valid(batch.column("shingles")))
        for bucket, *parts in zip(*(packed.column(c).to_pylist() for c in ("bucket", "digests", "counts", "shingles"))):
            for kept, part, kind in zip(held.setdefault(bucket, ([], [], [])), parts, ("<i8", "<u4", width)):
                kept.append(np.frombuffer(part, kind))
        if others is not None and (docs := batch.filter(pa.compute.is_valid(batch.column("n")))).num_rows:
            others.append(docs)
    for bucket in list(held):
        digests, counts, shingles = (np.concatenate(x) for x in held.pop(bucket))
        _, first = np.unique(digests, return_index=True)  # a set that several tasks have sent counts once
        keep = np.zeros(len(digests), bool)
        keep[first] = True
        owner = np.repeat(np.arange(len(digests)), counts)
        kept = keep[owner]
        yield digests, owner[kept], shingles[kept]


def _deal(digests: np.ndarray, buckets: int, sizes: np.ndarray, *flat: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Sets and what belongs to them, packed for each target bucket of their digests: at most one row a target.

    sizes: how many entries of each array of flat a set has, in order.
    """
    target = (digests % buckets).astype(np.int64)
    order = np.argsort(target, kind="stable")
    begins, starts = np.cumsum(sizes) - sizes, np.append(np.flatnonzero(np.diff(target[order], prepend=-1)), len(order))
    for a, b in zip(starts[:-1], starts[1:]):
        mine = order[a:b]
        n = sizes[mine]
        entries = np.repeat(begins[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield int(target[mine[0]]), [digests[mine].tobytes(), n.astype(np.uint32).tobytes(), *(f[entries].tobytes() for f in flat)]


def _count_shared(buckets: int):
    """Rows of documents as they are; and for the sets of a bucket, packed by target, how many of its shingles others have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(f"{_DOC}, target int, digests binary, shared binary")
        docs: list[pa.RecordBatch] = []
        for digests, owner, shingles in _by_bucket(batches, "<u4", docs):
            keys = (shingles.astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64)
            keys.sort()
            same = (keys[1:] >> np.uint64(32)) == (keys[:-1] >> np.uint64(32))
            shared = np.zeros(len(keys), bool)
            shared[1:] |= same
            shared[:-1] |= same
            counts = np.bincount((keys[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(digests))
            some = np.flatnonzero(counts)
            dealt = list(_deal(digests[some], buckets, np.ones(len(some), np.int64), counts[some].astype(np.uint32)))
            yield _batch(schema, {"target": [t for t, _ in dealt], "digests": [p[0] for _, p in dealt], "shared": [p[2] for _, p in dealt]}, len(dealt))
        for d in docs:
            yield _batch(schema, {"doc_id": d.column("doc_id"), "n": d.column("n"), "sid": d.column("sid")}, d.num_rows)

    return run


def _sum_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid and shared, summed up over the buckets; sums are kept, not their parts."""
    digests, sums, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add() -> None:
        nonlocal digests, sums, held, size
        names = np.concatenate([digests, *(d for d, _ in held)])
        weights = np.concatenate([sums, *(c for _, c in held)])
        digests, at = np.unique(names, return_inverse=True)
        sums, held, size = np.bincount(at, weights, len(digests)).astype(np.int64), [], 0

    for batch in batches:
        for d, c in zip(batch.column("digests").to_pylist(), batch.column("shared").to_pylist()):
            held.append((np.frombuffer(d, "<i8"), np.frombuffer(c, "<u4")))
            size += len(held[-1][0])
            if size > FLUSH:
                add()
    add()
    yield _batch(_schema("sid long, shared long"), {"sid": digests, "shared": sums}, len(digests))


def _sets_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema("sid long, n int, shingles binary")
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in slices(offsets, SLICE_BYTES):
            sets, digests = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield _batch(schema, {"sid": digests, "n": np.array([len(s) for s in sets], np.int32), "shingles": [s.tobytes() for s in sets]}, b - a)


def _send_sets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, packer = _schema(_PACKED), _Packer(buckets, "<u8")
        for batch in batches:
            for digest, body in zip(batch.column("sid").to_pylist(), batch.column("shingles").to_pylist()):
                packer.add(digest, np.frombuffer(body, "<u8"))
                if packer.size >= FLUSH:
                    out = packer.flush()
                    yield _batch(schema, out, len(out["bucket"]))
        if packer.size:
            out = packer.flush()
            yield _batch(schema, out, len(out["bucket"]))

    return run


_FOUND = "target int, digests binary, counts binary, shingles binary, found binary"


def _count_sets(buckets: int):
    """For the sets of a bucket, packed by target: their shingles that other sets have too, and in how many sets they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_FOUND)
        for digests, owner, shingles in _by_bucket(batches, "<u8"):
            order = np.argsort(shingles, kind="stable")
            flat, owner = shingles[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            counts = np.diff(np.append(first, len(flat)))
            found = np.repeat(counts, counts).astype(np.uint32)
            keep = found > 1
            flat, owner, found = flat[keep], owner[keep], found[keep]
            order = np.argsort(owner, kind="stable")
            flat, owner, found = flat[order], owner[order], found[order]
            some, sizes = np.unique(owner, return_counts=True)
            dealt = list(_deal(digests[some], buckets, sizes, flat, found))
            yield _batch(schema, {"target": [t for t, _ in dealt]} | {c: [p[i] for _, p in dealt] for i, c in enumerate(("digests", "counts", "shingles", "found"))}, len(dealt))

    return run


def _order_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared shingles of each set of a target in the global order, rarest first, and in how many sets each is."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for target, *parts in zip(*(batch.column(c).to_pylist() for c in ("target", "digests", "counts", "shingles", "found"))):
            held.setdefault(target, []).append(tuple(np.frombuffer(p, kind) for p, kind in zip(parts, ("<i8", "<u4", "<u8", "<u4"))))
    for target in list(held):
        digests, counts, shingles, found = (np.concatenate(x) for x in zip(*held.pop(target)))
        owner = np.repeat(digests, counts)
        order = np.lexsort((shingles, found, owner))
        owner, shingles, found = owner[order], shingles[order].view(np.int64), found[order].astype(np.int32)
        starts = np.append(np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))), len(owner))
        for i in range(0, len(starts) - 1, 2000):
            at = starts[i : i + 2001]
            body = slice(at[0], at[-1])
            lists = [pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(x[body])) for x in (shingles, found)]
            yield pa.RecordBatch.from_arrays([pa.array(owner[at[:-1]]), *lists], names=["sid", "shingles", "found"])


class _Tree:
    """A node of the prefix tree: a run of ranks, what hangs below, and bounds over the sets in it."""

    __slots__ = ("below", "depth", "ends", "least", "longest", "members", "run")

    def __init__(self, run: np.ndarray, depth: int):
        self.run, self.depth = run, depth  # depth: ranks above the run
        self.below: dict[int, _Tree] = {}
        self.ends: list[int] = []
        self.members: list[int] = []
        self.least, self.longest = 1 << 60, 0  # least size and most ranks of a set in it

    def take(self, x: int, size: int, length: int) -> None:
        self.members.append(x)
        self.least, self.longest = min(self.least, size), max(self.longest, length)


class PrefixTreeJoin:
    """Unites sets that link, one by one. ranks: sorted ranks in the order of the tree; size: of the whole set."""

    def __init__(self) -> None:
        self.root = _Tree(np.zeros(0, np.int64), 0)
        self.parent: list[int] = []
        self.sizes: list[int] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def _settled(self, node: _Tree, x: int) -> bool:
        roots = {self.find(m) for m in node.members}
        node.members = list(roots)
        return roots == {self.find(x)}

    def seek(self, x: int, ranks: np.ndarray) -> None:
        size, length = self.sizes[x], len(ranks)
        stack = [(child, 0) for child in self.root.below.values()]
        held = set(ranks.tolist())
        stack.sort(key=lambda s: int(s[0].run[0]) in held)
        while stack:
            node, shared = stack.pop()
            need = -(-SIZES * (size + node.least) // SHARED)
            if self._settled(node, x):
                continue
            at = np.minimum(np.searchsorted(ranks, node.run), length - 1)
            shared += int(np.count_nonzero(ranks[at] == node.run))
            depth = node.depth + len(node.run)
            passed = int(np.searchsorted(ranks, node.run[-1], "right"))  # of the seeker, up to here
            if shared + length - passed < need or shared + node.longest - depth < need:
                continue
            for y in node.ends:
                if SHARED * shared >= SIZES * (size + self.sizes[y]):
                    self.parent[self.find(x)] = self.find(y)
            nearer = [(c, shared) for c in node.below.values()]
            nearer.sort(key=lambda s: int(s[0].run[0]) in held)
            stack += nearer

    def insert(self, x: int, ranks: np.ndarray) -> None:
        node, at, length, size = self.root, 0, len(ranks), self.sizes[x]
        while at < length:
            child = node.below.get(key := int(ranks[at]))
            if child is None:
                child = node.below[key] = _Tree(ranks[at:], at)
                child.take(x, size, length)
                child.ends.append(x)
                return
            n = min(len(child.run), length - at)
            differ = np.flatnonzero(child.run[:n] != ranks[at : at + n])
            common = int(differ[0]) if len(differ) else n
            if common < len(child.run):  # the rest of the run moves below
                upper = _Tree(child.run[:common], child.depth)
                upper.members, upper.least, upper.longest = list(child.members), child.least, child.longest
                child.run, child.depth = child.run[common:], child.depth + common
                upper.below[int(child.run[0])] = child
                node.below[key] = child = upper
            child.take(x, size, length)
            at += common
            node = child
        node.ends.append(x)

    def add(self, ranks: np.ndarray, size: int, unite_with: int | None = None) -> int:
        x = len(self.parent)
        self.parent.append(x if unite_with is None else self.find(unite_with))
        self.sizes.append(size)
        self.seek(x, ranks)
        self.insert(x, ranks)
        return x


def _join_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """sid and leader (least sid of those united) for the sets of each block in a group; label: component so far."""
    out = []
    for _, block in pdf.groupby("block", sort=False):
        flat, found = np.concatenate(block["shingles"].tolist()), np.concatenate(block["found"].tolist())
        _, first, back = np.unique(flat, return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.lexsort((flat[first], -found[first].astype(np.int64)))] = np.arange(len(first))
        ranks = np.split(rank[back], np.cumsum([len(s) for s in block["shingles"]])[:-1])
        tree, known = PrefixTreeJoin(), {}
        for r, size, label in zip(ranks, block["n"].tolist(), block["label"].tolist()):
            known.setdefault(label, tree.add(np.sort(r), size, known.get(label)))
        roots = [tree.find(x) for x in range(len(block))]
        least: dict[int, int] = {}
        for root, sid in zip(roots, block["sid"].tolist()):
            least[root] = min(sid, least.get(root, sid))
        out.append(pd.DataFrame({"sid": block["sid"].to_numpy(), "leader": [least[r] for r in roots]}))
    return pd.concat(out)


def ordered_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of nodes (sid, n, rep) in the global order among themselves; without those that can't have a partner."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = with_ids(docs.select("doc_id", "text"), nodes.select(F.col("rep").alias("doc_id")), ["doc_id"], "left_semi")
    sets = texts.select("text").transform(map_arrow, _sets_again, "sid long, n int, shingles binary", then=forget_powers).join(nodes.select("sid", "rep"), "sid").dropDuplicates(["sid"])
    sets = materialize(sets, "sets")
    counted = sets.select("sid", "shingles").transform(map_arrow, _send_sets(buckets), _PACKED).repartition(buckets, "bucket").transform(map_arrow, _count_sets(buckets), _FOUND)
    ordered = counted.repartition(buckets, "target").transform(map_arrow, _order_sets, "sid long, shingles array<long>, found array<int>")
    # a prefix has what may be missing, and one more; those that no other set has come first and aren't listed
    prefix = F.expr("size(shingles) - (4 * n + 4) div 5 + 1").cast("int")
    return materialize(ordered.join(sets.select("sid", "rep", "n"), "sid").withColumn("prefix", prefix).where("prefix > 0"), "ordered")


def blocks_of(ordered: DataFrame) -> DataFrame:
    """sid and block of every set that shares a shingle of its prefix with another's, by any chain of such sets."""
    uses = ordered.select("sid", F.explode(F.slice("shingles", F.lit(1), F.col("prefix"))).alias("h"))
    hubs = uses.groupBy("h").agg(F.min("sid").alias("hub"), F.count("*").alias("k")).where("k > 1").drop("k")
    edges = uses.join(hubs, "h").where("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b"))
    return connected_components(edges).select(F.col("node").alias("sid"), F.col("component").alias("block"))


def _joined(rows: DataFrame, *keys: str) -> DataFrame:
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return _join_groups(pdf)
        finally:
            release()

    bound_batches(rows.sparkSession)
    return rows.groupBy(*keys).applyInPandas(join, "sid long, leader long")


def linked_sets(ordered: DataFrame) -> DataFrame:
    """sid and leader for all sets that link with another, directly or by a chain."""
    blocks = materialize(blocks_of(ordered), "blocks")
    sizes = blocks.groupBy("block").count()
    rows = ordered.join(blocks.join(sizes, "block"), "sid").withColumn("label", F.col("sid"))
    groups = max(1, blocks.count() // TASK_SETS)
    small = rows.where(F.col("count") <= CHUNK).withColumn("task", F.pmod(F.xxhash64("block"), F.lit(groups)))
    found = materialize(_joined(small, "task"), "links")
    many = sizes.where(F.col("count") > CHUNK)
    if many.isEmpty():
        return found
    large = materialize(rows.where(F.col("count") > CHUNK).withColumn("chunks", F.ceil(F.col("count") / CHUNK)), "large")
    chunk = F.pmod(F.xxhash64("sid"), F.col("chunks"))
    links = materialize(_joined(large.withColumn("chunk", chunk), "block", "chunk"), "links")
    # one set of each chunk's components, and then whole chunks in pairs as far as components still differ
    leaders = large.join(links.where("sid = leader").select("sid"), "sid")
    links = materialize(links.unionByName(_joined(leaders.withColumn("chunk", chunk % F.greatest(F.lit(1), F.col("chunks") / 8).cast("long")), "block", "chunk")), "links")
    label = connected_components(links.select(F.col("sid").alias("a"), F.col("leader").alias("b"))).select(F.col("node").alias("sid"), F.col("component").alias("label"))
    named = large.drop("label").join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    # sets outside a block's main component get chunks of their own: two chunks of the main one needn't meet
    parts = named.groupBy("block", "label").agg(F.count("*").alias("k"))
    main = parts.groupBy("block").agg(F.max_by("label", F.struct("k", "label")).alias("main"), (F.sum("k") - F.max("k")).alias("rest"))
    other = F.col("chunks") + F.pmod(F.xxhash64("sid"), F.ceil((F.col("rest") + 1) / CHUNK))
    dealt = materialize(named.join(main, "block").withColumn("chunk", F.when(F.col("label") == F.col("main"), chunk).otherwise(other)), "dealt")
    pure = dealt.groupBy("block", "chunk").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    left, right = pure.select("block", F.col("chunk").alias("i"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1")), pure.select("block", F.col("chunk").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = left.join(right, "block").where("i < j AND NOT (lo1 = hi1 AND lo2 = hi2 AND lo1 = lo2)").select("block", "i", "j")
    both = dealt.join(pairs.select("block", "i", "j", F.explode(F.array("i", "j")).alias("chunk")), ["block", "chunk"])
    more = _joined(both, "block", "i", "j")
    whole = links.unionByName(more).select(F.col("sid").alias("a"), F.col("leader").alias("b"))
    return found.unionByName(connected_components(whole).select(F.col("node").alias("sid"), F.col("component").alias("leader")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for every row."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.transform(map_arrow, _send_shingles(buckets), f"{_PACKED}, {_DOC}", then=forget_powers).repartition(buckets, "bucket")
    counted = materialize(sent.transform(map_arrow, _count_shared(buckets), f"{_DOC}, target int, digests binary, shared binary"), "shared")
    rows = counted.where(F.col("n").isNotNull()).select("doc_id", "n", "sid")
    nodes = rows.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"))
    shared = counted.where(F.col("target").isNotNull()).select("target", "digests", "shared").repartition(buckets, "target").transform(map_arrow, _sum_shared, "sid long, shared long")
    near = materialize(nodes.join(shared, "sid").where(5 * F.col("shared") >= 4 * F.col("n")).select("sid", "n", "rep"), "near")
    ordered = ordered_sets(docs, near)
    links = materialize(linked_sets(ordered), "linked")
    named = links.join(ordered.select("sid", "rep"), "sid")
    least = named.groupBy("leader").agg(F.min("rep").alias("component"))
    found = named.join(least, "leader").select("sid", "component")
    table = nodes.join(found, "sid", "left").select("sid", F.least("component", "rep").alias("component_id"))
    joined = rows.join(table, "sid", "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id. All columns stay; rows without id stay."""
    found = jaccard_components(docs)
    dropped = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return with_ids(docs, dropped, ["doc_id"], "left_anti").select(*columns_of(docs))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under a Jaccard similarity of 0.8 of their 5-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS sh FROM w
), g AS (
  SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh
), u AS (
  SELECT rep, n, unnest(sh) AS h FROM g
), links AS (
  SELECT a.rep AS x, b.rep AS y FROM u a JOIN u b ON a.h = b.h AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT rep AS x, rep AS y FROM g
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), c AS (
  SELECT x, min(y) AS component FROM reach GROUP BY x
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.component, s.doc_id) AS component_id
FROM s LEFT JOIN g ON len(s.sh) > 0 AND s.sh = g.sh LEFT JOIN c ON c.x = g.rep
"""
