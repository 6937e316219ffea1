"""Token ids in a content-addressed store.

Texts are encoded in tasks; a rolling hash over the ids cuts each document's stream into chunks, whose BLAKE2 digest is
their name. A chunk is stored once: tasks send each chunk at most once, and the store's hash partitions keep the first of
a name. Recipes list the chunks of each document in ascending doc_id. A Merkle tree stands over the recipes: a leaf is
the hash of all that a recipe says, and the hashes of MERKLE_FAN leaves, of a part's nodes and of all parts end in one
root. A reader works the tree out anew from the recipes and holds it against the manifest before it puts anything together.

Files, all Parquet under one folder: parts/kind=chunk(digest, body) with body = one byte of width (2 or 4) and little-endian ids;
recipes(part, place, doc_id, n_tokens, digests, sizes), the digests joined, 16 bytes each; manifest(part, block, root) with
block -1 for a part's own root and part -1 for that of the store.

Null text counts as empty and still has its end id; rows that share a doc_id keep an order by where they were read; a
null doc_id comes first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.llm.common import shared_dir
from cloakwork.llm.memory import map_arrow, map_pandas

#: A cut falls after an id where WINDOW hashed ids leave zero under MASK: every 256 ids on average.
WINDOW_DOUBLINGS, MASK = 5, np.uint64(255 << 40)
LEAST, MOST = 64, 2048
MERKLE_FAN, NAME_BYTES = 256, 16
#: A worker forgets pieces met in one slice alone, and a task chunk names, beyond this many.
MOST_WORDS, MOST_NAMES = 400_000, 200_000
SLICE_CHARS = 4_000_000
#: Texts are encoded this many bytes at a time, and cut this many ids at a time (one text at least).
SLICE_BYTES, CUT_IDS = 6_000_000, 500_000
#: A text with more bytes is split in Python, and a worker forgets beyond so many, as Arrow's strings end at 2 GB.
LONG_TEXT = 1 << 28
#: So many new words go to the library as one text.
JOINED = 500
_GAP = re.compile(r"(?<=\S)(?= \S)")
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space beside white space, or a space at either end.
_ODD = rf"[{_SPACE}]{{2}}|\A | \z"
#: Pieces that can stand beside others behind a space, or behind a line feed if _MARK begins them.
_JOINS, _JOINS_LINES = rf"\A[^<\x{{e000}}{_SPACE}]+\z", rf"\A\x{{e000}}[^<\x{{e000}}{_SPACE}]+\z"
_MARK = "\ue000"
#: Signs that are cut off a part's end behind these letters and digits, which are letters and numbers in every version of
#: Unicode. Without the apostrophe, which begins contractions, and ">", which ends an added token.
_TAIL, _BEFORE_TAIL = '.,;:!?#$%&*|)]}"-', r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]\z"


def _picked(flat: np.ndarray, starts: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat with these numbers, one after the other, and their n + 1 offsets."""
    sizes = starts[where + 1] - starts[where]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.repeat(starts[where] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _without_tails(keys: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray, np.ndarray]:
    """Keys without the signs at their end, the keys of those signs, and which keys had any.

    The pattern ends a run of letters or digits before such a sign, and a key ends before white space or with the text,
    so what is cut off has the tokens that it has alone.
    """
    cut = pc.utf8_rtrim(keys, _TAIL)
    sizes = pc.subtract(pc.binary_length(keys), pc.binary_length(cut)).to_numpy().astype(np.int64)
    has = pc.and_(pa.array(sizes > 0), pc.match_substring_regex(cut, _BEFORE_TAIL))
    had = has.to_numpy(zero_copy_only=False)
    at = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64) if len(keys) else np.zeros(1, np.int64)
    sizes = sizes[had]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    body = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[np.repeat(at[1:][had] - ends[1:], sizes) + np.arange(ends[-1])]
    tails = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes()))
    return pc.if_else(has, cut, keys), pc.binary_join_element_wise(_MARK, tails, ""), had


class Encoder:
    """The tokenizers library behind a memory of pieces.

    A single space between two other characters always starts a token of the byte-level pattern, and a single line feed
    is one, so the parts of a text between such places can be encoded apart, without the signs at their end, and each
    different piece once. A part's key is what follows its space; _MARK stands before the key of a part without that
    space. New pieces without other white space are put together and encoded as one text: the tokens that begin with a
    space, or the line feeds, tell where each starts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.after_space = np.zeros(max(vocabulary.values()) + 1, bool)
        self.after_space[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.line_feed = vocabulary.get("\u010a", -1)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())  # keys in the order of their numbers
        self.flat, self.starts, self.met = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _forget_rare(self) -> None:
        """Keep the pieces that were met again since the last time."""
        keep = np.flatnonzero(self.met > 1)
        self.flat, self.starts = _picked(self.flat, self.starts, keep)
        self.known, self.met = self.known.take(pa.array(keep)), np.ones(len(keep), np.int32)

    @staticmethod
    def parts(text: str) -> list[str]:
        """Keys of the parts of any text."""
        if _MARK in text:
            return [_MARK + text]
        return [p[1:] if p[0] == " " and i else _MARK + p for i, p in enumerate(_GAP.split(text))] if text else []

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new keys from the library, flat, and the n + 1 offsets of the keys."""
        order, flat, sizes, single = [], [], [], np.ones(len(keys), bool)
        for pattern, sign in ((_JOINS, " "), (_JOINS_LINES, "\n")):
            which = np.flatnonzero(pc.match_substring_regex(keys, pattern).to_numpy(zero_copy_only=False))
            words = keys.take(pa.array(which))
            at = np.append(np.arange(0, len(which), JOINED), len(which))
            groups = pa.ListArray.from_arrays(pa.array(at, pa.int32()), words if sign == " " else pc.utf8_slice_codeunits(words, 1))
            for k, text in enumerate(pc.binary_join(groups, sign).to_pylist()):
                ids, own = np.array(self._batch([sign + text])[0], np.int32), which[at[k] : at[k + 1]]
                first = self.after_space[ids] if sign == " " else ids == self.line_feed
                begin = np.flatnonzero(first)
                if len(begin) == len(own):
                    order.append(own)
                    flat.append(ids if sign == " " else ids[~first])
                    sizes.append(np.diff(np.append(begin, len(ids))) - (sign != " "))
                    single[own] = False
        order.append(np.flatnonzero(single))
        got = self._batch([k[1:] if k.startswith(_MARK) else " " + k for k in keys.filter(pa.array(single)).to_pylist()])
        sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        flat.append(np.fromiter(chain.from_iterable(got), np.int32, int(sizes[-1].sum())))
        back = np.empty(len(keys), np.int64)
        back[np.concatenate(order)] = np.arange(len(keys))
        return _picked(np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), back)

    def _ids_of(self, keys: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different keys, flat, and the n + 1 offsets of the keys."""
        bases, tails, had = _without_tails(keys)
        codes = pa.concat_arrays([bases, tails]).dictionary_encode()
        pieces = codes.dictionary
        place = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().astype(np.int64)
        if len(new := np.flatnonzero(place < 0)):
            place[new] = len(self.known) + np.arange(len(new))
            fresh = pieces.take(pa.array(new))
            ids, at = self._learn(fresh)
            self.known = pa.concat_arrays([self.known, fresh])
            self.flat, self.starts = np.concatenate((self.flat, ids)), np.concatenate((self.starts, self.starts[-1] + at[1:]))
            self.met = np.append(self.met, np.zeros(len(new), np.int32))
        self.met[place] += 1
        place = place[codes.indices.to_numpy()]
        upto = np.cumsum(1 + had)  # pieces of the keys so far
        both = np.empty(len(place), np.int64)
        both[upto - 1 - had], both[upto[had] - 1] = place[: len(keys)], place[len(keys) :]
        ids, at = _picked(self.flat, self.starts, both)
        return ids, at[np.concatenate(([0], upto))]

    def encode(self, texts: pa.StringArray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), flat, each followed by end, and the n + 1 offsets of the texts."""
        if len(self.known) > MOST_WORDS or self.known.nbytes > LONG_TEXT:
            self._forget_rare()
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.or_(pc.match_substring(texts, _MARK), pc.greater(pc.binary_length(texts), LONG_TEXT)))
        lines = pc.replace_substring(texts.filter(pc.invert(odd)), "\n", f" {_MARK}\n {_MARK}")
        simple = pc.split_pattern(pc.binary_join_element_wise(_MARK, lines, ""), " ")
        others = pa.array(map(self.parts, texts.filter(odd).to_pylist()), pa.list_(pa.string()))
        lists = pa.concat_arrays([simple, others])
        words = lists.flatten().dictionary_encode()
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        del lines, simple, others, lists  # several times the texts
        own, starts = self._ids_of(words.dictionary)
        begins = np.cumsum(counts) - counts
        odd = odd.to_numpy(zero_copy_only=False)
        order = np.empty(len(texts), np.int64)  # where each text is in lists
        order[np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))] = np.arange(len(texts))
        counts, begins = counts[order], begins[order]
        last = np.cumsum(counts)
        where = words.indices.to_numpy()
        if odd.any():
            where = where[np.repeat(begins - (last - counts), counts) + np.arange(counts.sum())]
        ids, ends = _picked(own, starts, where)
        at = ends[np.concatenate(([0], last))]
        if end is not None:
            ids = np.insert(ids, at[1:], end)
            at = at + np.arange(len(at))
        return ids, at


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_GEAR = np.random.default_rng(9).integers(0, 2**64, 1 << 16, np.uint64)


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end in a run of ids of many documents.

    What lies LEAST ids or more into a document is decided by its own ids alone, as WINDOW hashed ids are fewer.
    """
    h = _GEAR[ids & 0xFFFF] + (ids >> 16).astype(np.uint64)
    for k in range(WINDOW_DOUBLINGS):
        step = 1 << k
        grown = h.copy()
        grown[step:] += h[:-step] << np.uint64(step)
        h = grown
    return np.flatnonzero((h & MASK) == 0) + 1


def cut_points(marks: list[int], n: int) -> list[int]:
    """Ends of the chunks of one document of n ids, of its marks: content decides, within LEAST and MOST."""
    ends, last = [], 0
    for c in marks:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            last = c
            ends.append(last)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def unpack(body: bytes) -> np.ndarray:
    return np.frombuffer(body, "<u2" if body[0] == 2 else "<u4", offset=1)


def name_of(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=NAME_BYTES).digest()


@dataclass(frozen=True)
class Store:
    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if kind := _KINDS.get(name):
            return spark.read.schema(f"{_SCHEMAS[name]}, kind string").parquet(f"{self.path}/parts").where(F.col("kind") == kind).drop("kind")
        return spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}")


_KINDS = {"chunks": "chunk", "unordered": "recipe"}
_RECIPE = "doc_id long, n_tokens long, digests binary, sizes array<int>"
_ROW = f"kind string, digest binary, body binary, source_row long, {_RECIPE}"
_SCHEMAS = {
    "chunks": "digest binary, body binary", "recipes": f"part int, place long, {_RECIPE}", "manifest": "part int, block long, root string",
    "unordered": f"source_row long, {_RECIPE}",
}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of SLICE_BYTES of text (one row at least), as more rows share more words."""

    names = ["text", "doc_id", "source_row"]

    def joined() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in held]) for k in names], names=names)

    held, size, turns = [], 0, 0
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column("text").cast(pa.string()), *map(batch.column, names[1:])], names=names)
        upto = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        turn = np.flatnonzero(np.diff(upto // SLICE_BYTES, prepend=turns))
        size = int(upto[-1]) if len(upto) else size
        turns = size // SLICE_BYTES
        for k, (a, b) in enumerate(pairwise([0, *turn.tolist(), batch.num_rows])):
            if k and held:
                yield joined()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield joined()


def _encode_task(tokenizer_path: str, end: int | None):
    fields = [("kind", pa.string()), ("digest", pa.binary()), ("body", pa.binary()), ("source_row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("sizes", pa.list_(pa.int32()))]

    def rows(n: int, kind: str, **columns) -> pa.RecordBatch:
        columns["kind"] = pa.array([kind] * n, pa.string())
        return pa.RecordBatch.from_arrays([columns.get(f, pa.nulls(n, t)) for f, t in fields], schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, sent = encoder(tokenizer_path), set()
        for batch in _slices(batches):
            every, at = library.encode(batch.column("text"), end)
            turn = np.flatnonzero(np.diff(at[1:] // CUT_IDS)) + 1
            for a, b in pairwise([0, *turn.tolist(), batch.num_rows]):
                ids, ends = every[at[a] : at[b]], at[a : b + 1] - at[a]
                width, kind = (2, "<u2") if not len(ids) or int(ids.max()) < 65536 else (4, "<u4")
                raw, head = ids.astype(kind).tobytes(), bytes((width,))
                marks = cut_marks(ids)
                first = np.searchsorted(marks, ends, "right").tolist()
                names, bodies, digests, sizes, counts = [], [], [], [], [0]
                for k, (begin, stop) in enumerate(pairwise(ends.tolist())):
                    own, last = [], 0
                    cuts = cut_points((marks[first[k] : first[k + 1]] - begin).tolist(), stop - begin)
                    for c in cuts:
                        body = head + raw[width * (begin + last) : width * (begin + c)]
                        own.append(name := name_of(body))
                        sizes.append(c - last)
                        last = c
                        if name not in sent:
                            if len(sent) >= MOST_NAMES:
                                sent.clear()
                            sent.add(name)
                            names.append(name)
                            bodies.append(body)
                    digests.append(b"".join(own))
                    counts.append(len(sizes))
                yield rows(len(names), "chunk", digest=pa.array(names, pa.binary()), body=pa.array(bodies, pa.binary()), source_row=pa.array(np.zeros(len(names), np.int64)))
                part = {f: batch.column(f).slice(a, b - a) for f in ("doc_id", "source_row")}
                lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(sizes, pa.int32()))
                yield rows(b - a, "recipe", n_tokens=pa.array(np.diff(ends), pa.int64()), digests=pa.array(digests, pa.binary()), sizes=lists, **part)

    return run


def _first_of_name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes, and the first chunk of each name; the names of one partition are held."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for digest in batch.column("digest").to_pylist():  # a recipe has none
            keep.append(digest is None or digest not in seen)
            if digest is not None:
                seen.add(digest)
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, tokenizer_path: str, end: int | None = None, path: str | None = None) -> Store:
    """Encode all documents and write the store's files; texts and ids are shuffled once, without repeated chunks."""
    spark = docs.sparkSession
    store = Store(path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("source_row"))
    made = source.transform(map_arrow, _encode_task(tokenizer_path, end), _ROW)
    dealt = made.repartition(F.coalesce(F.xxhash64("digest", "source_row"), F.lit(0)))
    dealt.transform(map_arrow, _first_of_name, _ROW).write.partitionBy("kind").option("compression", "zstd").parquet(f"{store.path}/parts")
    recipes = store.table(spark, "unordered")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = recipes.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "source_row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "source_row")
    ordered.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "doc_id", "n_tokens", "digests", "sizes").write.parquet(f"{store.path}/recipes")
    merkle(store.table(spark, "recipes")).write.parquet(f"{store.path}/manifest")
    return store


def merkle(recipes: DataFrame) -> DataFrame:
    """part, block, root of every node above the leaves: of MERKLE_FAN recipes in turn, of each part, and of all."""
    said = F.concat_ws("|", "place", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_tokens", F.concat_ws(",", F.col("sizes").cast("array<string>")))
    leaves = recipes.select("part", "place", F.sha2(F.concat(F.encode(said, "UTF-8"), "digests"), 256).alias("root"))
    joined = lambda *order: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "root"))), lambda x: x["root"]), ""), 256).alias("root")
    blocks = leaves.groupBy("part", F.floor(F.col("place") % 2**33 / MERKLE_FAN).alias("block")).agg(joined("place"))
    parts = blocks.groupBy("part").agg(joined("block")).select("part", F.lit(-1).cast("long").alias("block"), "root")
    whole = parts.groupBy().agg(joined("part")).select(F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("block"), "root")
    return blocks.unionByName(parts).unionByName(whole)


def _table_of(columns: np.ndarray) -> np.ndarray:
    """What a 32 x 32 bit matrix makes of each value of each of four bytes."""
    bits = np.arange(256)[:, None] >> np.arange(8) & 1
    return np.bitwise_xor.reduce(np.where(bits, columns.reshape(4, 1, 8), 0), axis=2)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def _append_zeros(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a longer string, in which so many bytes follow."""
    columns = np.array([0xEDB88320, *(1 << k for k in range(31))], np.int64)  # fixed value: the CRC-32 polynomial; the effect of one zero bit
    out = crc.astype(np.int64)
    for k in range(3 + int(n_bytes.max(initial=0)).bit_length()):
        table = _table_of(columns)
        if k >= 3 and len(at := np.flatnonzero(n_bytes >> (k - 3) & 1)):
            out[at] = _apply(table, out[at])
        columns = _apply(table, columns)
    return out


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes, crcs = batch.column("digest"), [], []
        for digest, body in zip(digests.to_pylist(), batch.column("body").to_pylist()):
            if name_of(body) != digest:
                raise ValueError(f"chunk {digest.hex()} doesn't hold what its name says")
            ids = unpack(body)
            sizes.append(len(ids))
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([digests, pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])


def _join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = batch.column("parts")
        flat, counts = parts.flatten(), parts.value_lengths().to_numpy()
        n_bytes, crc = 4 * flat.field("n").to_numpy().astype(np.int64), flat.field("crc").to_numpy()
        upto, first = np.cumsum(n_bytes), np.cumsum(counts) - counts
        total = upto[first + counts - 1]  # a document has one chunk at least here
        yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(np.bitwise_xor.reduceat(_append_zeros(crc, np.repeat(total, counts) - upto), first))], names=["place", "ids_crc32"])


def _uses(recipes: DataFrame) -> DataFrame:
    """place, pos, size and digest of every chunk of every recipe."""
    each = recipes.select("place", "digests", F.posexplode("sizes").alias("pos", "size"))
    return each.select("place", "pos", "size", F.substring("digests", F.col("pos") * NAME_BYTES + 1, F.lit(NAME_BYTES)).alias("digest"))


def read_digests(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the store's files.

    Every chunk is read once and held against its name; a document's checksum is put together from those of its
    chunks, in the order of its recipe, so no ids are shuffled. A missing chunk, a size that differs or a recipe that
    the manifest doesn't confirm is an error.
    """
    check(spark, store)
    recipes = store.table(spark, "recipes")
    read = store.table(spark, "chunks").transform(map_arrow, _read_chunks, "digest binary, n int, crc long")
    uses = _uses(recipes)
    found = uses.join(read, "digest", "left").withColumn("crc", F.when(F.col("n") == F.col("size"), F.col("crc")).otherwise(F.raise_error(F.lit("a recipe names a chunk that is missing or of another size"))))
    parts = found.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))
    crcs = parts.transform(map_arrow, _join_crcs, "place long, ids_crc32 long")
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = recipes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = sums.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = recipes.select("part", "place", "doc_id", "n_tokens", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inside")).join(F.broadcast(earlier), "part")
    return placed.join(crcs, "place", "left").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", F.coalesce("ids_crc32", F.lit(0)).alias("ids_crc32"))


def read_documents(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id and ids (array of long) of every document, put together from its chunks."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [np.concatenate([unpack(p["body"]) for p in parts]).astype(np.int64) if len(parts) else np.zeros(0, np.int64) for parts in pdf["parts"]]
            yield pd.DataFrame({"place": pdf["place"], "ids": ids})

    check(spark, store)
    recipes = store.table(spark, "recipes")
    parts = _uses(recipes).join(store.table(spark, "chunks"), "digest").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("parts"))
    ids = parts.transform(map_pandas, build, "place long, ids array<long>")
    return recipes.select("place", "doc_id").join(ids, "place", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def verify(spark: SparkSession, store: Store) -> DataFrame:
    """Merkle nodes whose root isn't that of the recipes; empty for a sound store."""
    now = merkle(store.table(spark, "recipes")).withColumnRenamed("root", "found")
    both = now.join(store.table(spark, "manifest"), ["part", "block"], "full")
    return both.where(~F.col("found").eqNullSafe(F.col("root")))


def check(spark: SparkSession, store: Store) -> None:
    """An error unless every recipe is as the manifest has it."""
    if bad := verify(spark, store).select("part", "block").first():
        raise ValueError(f"recipes differ from the manifest in part {bad['part']}, block {bad['block']}")


def op9_token_store(spark, sf_dir: str) -> DataFrame:
    """All documents through the store, each with the end id 2."""
    import public_tokenizers

    store = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return read_digests(spark, store)
