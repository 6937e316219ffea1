"""Byte-level BPE by forced-boundary splitting.

A pair of bytes that stands inside no token of the vocabulary can never be joined, nor can anything across it: a token
that held both would have the pair inside. So a text can be cut between the two bytes of every such pair, the fragments
encoded on their own, and their ids put one after the other. All new fragments of a batch are cut and told apart as one
byte array and merged together: in every round each fragment joins its pairs of least rank. Fragments longer than SHORT
bytes have a heap over linked neighbours each, so that a word of any length takes n log n steps.

Before that a text is split as the vocabulary's own rules have it: at special tokens, then by the pattern of words,
numbers, other signs and white space. Where a single space or line feed lies between two signs that aren't white space, and
before signs that end a word, both rules agree on a cut, so whole batches are split there first, by Arrow, and each
different piece is worked out once (token_store.Encoder).

Decoding looks every id's bytes up in one table and joins them; bytes that aren't UTF-8 become U+FFFD.

A null text is an empty one: no ids and an empty text. Rows that repeat an id or a text are rows of their own; a null
doc_id stays null; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.memory import map_arrow
from cloakwork.llm.token_store import SLICE_CHARS, Encoder
from cloakwork.llm.token_store import _MARK as MARK

#: Fixed value: the white space of the pattern below, as its own library has it.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Longer fragments are merged with a heap each.
SHORT = 256
NONE = np.iinfo(np.int32).max


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in the vocabulary file: itself if it is printable, else the next one from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 0xAD]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(column.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


class Vocabulary:
    """Tokens, ranks of merges and forced boundaries, from a vocabulary file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        signs, model = byte_signs(), file["model"]
        tokens = {t: bytes(map(signs.__getitem__, t)) for t in model["vocab"]}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.ids = {b: model["vocab"][t] for t, b in tokens.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(self.ids[tokens[a]], self.ids[tokens[b]]): (rank, self.ids[tokens[a] + tokens[b]]) for rank, (a, b) in enumerate(merges)}
        self.single = np.array([self.ids[bytes((b,))] for b in range(256)], np.int32)
        by_pair = sorted(((a << 32 | b), rank) for (a, b), (rank, _) in self.ranks.items())
        self.pairs, self.pair_ranks = np.array([p for p, _ in by_pair], np.int64), np.array([r for _, r in by_pair], np.int32)
        self.made = np.array([made for _, made in self.ranks.values()], np.int32)
        born = {made: rank for rank, made in self.ranks.values()}
        if any(rank <= born.get(part, -1) for pair, (rank, _) in self.ranks.items() for part in pair):
            raise ValueError(f"{path}: a merge stands before the one that makes its part")
        self.inside = np.zeros((256, 256), bool)
        for token in tokens.values():
            for pair in pairwise(token):
                self.inside[pair] = True
        bodies = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for body, i in self.ids.items():
            bodies[i] = body
        for sign, i in self.special.items():
            bodies[i] = sign.encode()
        self.flat = np.frombuffer(b"".join(bodies), np.uint8)
        self.sizes = np.array([len(b) for b in bodies], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def fragments(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces, cut inside every pair of bytes that no token holds: all fragments, and how many each piece has."""
        body, at = joined_bytes(pieces)
        first = np.zeros(len(body) + 1, bool)
        first[1:-1] = ~self.inside[body[:-1], body[1:]]
        first[at] = True
        starts = np.flatnonzero(first).astype(np.int32)
        made = pa.Array.from_buffers(pa.binary(), max(0, len(starts) - 1), [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(body.tobytes())])
        return made, np.diff(np.searchsorted(starts, at))

    def merged(self, fragments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments, and the n + 1 offsets of the fragments in them."""
        body, at = joined_bytes(fragments)
        sizes = np.diff(at)
        short = sizes <= SHORT
        ids, owner = self._by_rounds(self.single[body[np.repeat(short, sizes)]], np.repeat(np.flatnonzero(short), sizes[short]))
        counts = np.bincount(owner, minlength=len(sizes))
        if short.all():
            return ids, np.concatenate(([0], np.cumsum(counts)))
        long = {int(k): self._by_heap(self.single[body[at[k] : at[k + 1]]].tolist()) for k in np.flatnonzero(~short)}
        for k, own in long.items():
            counts[k] = len(own)
        ends = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(ends[-1], np.int32)
        out[np.repeat(short, counts)] = ids
        for k, own in long.items():
            out[ends[k] : ends[k + 1]] = own
        return out, ends

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where each pair stands among the merges, by rank; NONE if it is no merge."""
        pair = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], NONE)

    def _by_rounds(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the fragment of each, when every fragment has joined its pairs of least rank until it has none."""
        done_ids, done_owner = [], []
        while len(ids):
            rank = np.full(len(ids), NONE, np.int32)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self._ranked(ids[:-1], ids[1:]), NONE)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            open_ = np.repeat(least != NONE, size)
            done_ids.append(ids[~open_])
            done_owner.append(owner[~open_])
            hit = (rank == np.repeat(least, size))[open_]
            ids, owner, rank = ids[open_], owner[open_], rank[open_]
            if not len(ids):
                break
            # of pairs that overlap, as in a run of one sign, every second one is joined, from the left
            place = np.arange(len(ids))
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), place, 0))
            hit &= (place - run) % 2 == 0
            ids = np.where(hit, self.made[np.where(hit, rank, 0)], ids)
            keep = ~np.concatenate(([False], hit[:-1]))
            ids, owner = ids[keep], owner[keep]
        if not done_ids:
            return ids, owner
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def _by_heap(self, ids: list[int]) -> list[int]:
        ranks, n = self.ranks, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, *pair) for i, pair in enumerate(pairwise(ids)) if (r := ranks.get(pair))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two was joined with another
            ids[i], ids[j] = ranks[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]


class ForcedEncoder(Encoder):
    """Encoder whose new pieces are cut at forced boundaries, each fragment merged once."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.forget()

    def _learn(self, keys: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        v, pieces, counts, special = self.vocabulary, [], [], {}
        for text in (k[1:] if k.startswith(MARK) else " " + k for k in keys.to_pylist()):
            before = len(pieces)
            for i, stretch in enumerate(self.special.split(text) if self.special and self.special.search(text) else (text,)):
                if i % 2:
                    special[len(pieces)] = v.special[stretch]
                    pieces.append("")
                else:
                    pieces += PATTERN.findall(stretch)
            counts.append(len(pieces) - before)
        fragments, per_piece = v.fragments(pa.array(pieces, pa.string()))
        different = fragments.dictionary_encode()
        ids, at = v.merged(different.dictionary)
        if special:  # an empty piece has no fragment; its id is put in as one of its own
            where = np.cumsum(per_piece)[list(special)]
            codes = np.insert(different.indices.to_numpy().astype(np.int64), where, len(at) - 1 + np.arange(len(special)))
            ids, at = np.append(ids, np.array(list(special.values()), np.int32)), np.append(at, at[-1] + 1 + np.arange(len(special)))
            per_piece[list(special)] = 1
        else:
            codes = different.indices.to_numpy().astype(np.int64)
        sizes = at[codes + 1] - at[codes]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        fresh = ids[np.repeat(at[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
        per_key = ends[np.concatenate(([0], np.cumsum(per_piece)))][np.concatenate(([0], np.cumsum(counts)))]
        return fresh.astype(np.int32), per_key

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the ids of many texts, and the n + 1 offsets of the texts in them."""
        sizes = self.vocabulary.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        where = np.repeat(self.vocabulary.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.vocabulary.flat[where].tobytes(), ends[at]


_encoders: dict[str, ForcedEncoder] = {}


def encoder(path: str) -> ForcedEncoder:
    """One for each task and file; it ends with the task."""
    if path not in _encoders:
        _encoders[path] = ForcedEncoder(path)
    return _encoders[path]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    chars = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy())
    yield from pairwise([0, *(np.flatnonzero(np.diff(chars // SLICE_CHARS)) + 1).tolist(), len(texts)])


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            for a, b in _slices(texts):
                ids, at = encoder(path).encode(texts.slice(a, b - a), None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, "doc_id long, ids array<int>", then=_encoders.clear)


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of doc_id and ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            body, at = encoder(path).decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))))
            texts = [body[a:b].decode("utf-8", "replace") for a, b in pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").transform(map_arrow, run, "doc_id long, text string", then=_encoders.clear)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of each text's ids and of the text decoded from them, without moving the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda body: hashlib.sha256(body).hexdigest()
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            for a, b in _slices(texts):
                library = encoder(path)
                ids, at = library.encode(texts.slice(a, b - a), None)
                raw = ids.astype("<u4").tobytes()
                body, ends = library.decode(ids, at)
                columns = [
                    batch.column("doc_id").slice(a, b - a), pa.array(np.diff(at), pa.int64()),
                    pa.array([sha(raw[4 * i : 4 * j]) for i, j in pairwise(at.tolist())], pa.string()),
                    pa.array([sha(body[i:j].decode("utf-8", "replace").encode()) for i, j in pairwise(ends.tolist())], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, schema, then=_encoders.clear)


def op12_forced_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded with the 50k byte-level vocabulary."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
