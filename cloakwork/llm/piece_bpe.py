"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a batch are told apart once; the symbols of all new words lie in one flat numpy array. In every round each
word finds the best pair rank among its adjacent symbols (a segmented minimum) and merges its leftmost occurrence, or
all its disjoint occurrences at once where no merge among them can make a better pair; words without a pair leave the
array, and the rounds end when it is empty. The model file is read here; no library encodes.

A null text counts as empty; an empty text has no ids and decodes to an empty text; repeated rows are rows of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.memory import map_arrow

SPACE_MARK = "▁"
#: A task forgets its words beyond this many, and works on so many characters at a time.
MOST_WORDS = 300_000
SLICE_CHARS = 500_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_RUN = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message, as (number, value)."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, i = data[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """Vocabulary, pair ranks and flags of a BPE model file with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = f.read()
        self.pieces, scores, kinds = [], [], []
        normaliser = {1: b"identity", 3: 1, 4: 1, 5: 1}
        for number, value in _fields(message):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, _NORMAL))
            elif number == 3:
                normaliser |= dict(_fields(value))
        if normaliser[4] or normaliser.get(2) or not normaliser[3]:
            raise ValueError("only models of identity normalisation with a dummy prefix and kept white space")
        if set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("user-defined and unused pieces aren't supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == _NORMAL}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids):
            raise ValueError("pieces must not go over the start of a word")
        self.of_point = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        self.byte_ids = [next(i for i, p in enumerate(self.pieces) if kinds[i] == _BYTE and p == f"<0x{b:02X}>") for b in range(256)]
        rank = {s: i for i, s in enumerate(sorted(set(scores), reverse=True))}
        pairs = sorted(
            (self.ids[a] << 32 | self.ids[b], rank[scores[i]], i)
            for p, i in self.ids.items() for k in range(1, len(p)) if (a := p[:k]) in self.ids and (b := p[k:]) in self.ids
        )
        self.pair_keys, self.pair_rank, self.pair_out = (np.array(x, np.int64) for x in zip(*pairs))
        self.piece_bytes = [
            bytes([int(p[3:5], 16)]) if kinds[i] == _BYTE else b"" if kinds[i] == _CONTROL else b" \xe2\x81\x87 " if kinds[i] == _UNKNOWN else p.replace(SPACE_MARK, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.decimal = [str(i) for i in range(len(self.pieces))]


def _ranks(model: PieceModel, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and result of each pair of symbols; a rank beyond all others where they don't merge."""
    keys = left << 32 | right
    at = np.minimum(np.searchsorted(model.pair_keys, keys), len(model.pair_keys) - 1)
    hit = (model.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
    return np.where(hit, model.pair_rank[at], _NEVER), model.pair_out[at]


_NEVER = np.int64(1 << 40)


def _later_in_run(hit: np.ndarray) -> np.ndarray:
    """Every second one of directly following hits: they overlap the one before."""
    at = np.flatnonzero(hit)
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    out = np.zeros(len(hit), bool)
    out[at[(np.arange(len(at)) - run) % 2 == 1]] = True
    return out


def merge_words(model: PieceModel, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of all words, flat, and their starts (with the end). symbols: ids, or below 0 for what never merges."""
    n_words = len(starts) - 1
    word = np.repeat(np.arange(n_words), np.diff(starts))
    rank = np.full(len(symbols), _NEVER)
    out = np.zeros(len(symbols), np.int64)
    stale = np.arange(len(symbols) - 1)  # pairs whose rank isn't known
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        rank[-1] = _NEVER
        rank[stale], out[stale] = _ranks(model, symbols[stale], symbols[stale + 1])
        rank[stale[word[stale] != word[stale + 1]]] = _NEVER
        same = word[1:] == word[:-1]
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        best = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.append(first, len(symbols)))
        over = best == _NEVER
        if over.any():  # words without a pair are done; the array is compacted
            gone = np.repeat(over, sizes)
            done.append((word[gone], symbols[gone]))
            symbols, word, rank, out = symbols[~gone], word[~gone], rank[~gone], out[~gone]
            if not len(symbols):
                break
            best, sizes = best[~over], sizes[~over]
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        least = np.repeat(best, sizes)
        hit = rank == least
        leftmost = np.zeros(len(symbols), bool)
        at = np.flatnonzero(hit)
        leftmost[at[np.concatenate(([True], word[at][1:] != word[at][:-1]))]] = True
        hit &= ~_later_in_run(hit)
        if len(at) > len(first):  # several occurrences in some words: all at once only if no new pair comes before them
            at = np.flatnonzero(hit)
            made = out[at]
            risky = np.zeros(len(at), bool)
            before = np.where((at > 0) & (word[at - 1] == word[at]), symbols[at - 1], -1)
            after_at = np.minimum(at + 2, len(symbols) - 1)
            after = np.where((at + 2 < len(symbols)) & (word[after_at] == word[at]), symbols[after_at], -1)
            for left, right in ((before, made), (made, after), (made, made)):
                risky |= _ranks(model, left, right)[0] <= least[at]
            follows = np.concatenate(([False], (np.diff(at) == 2) & (word[at][1:] == word[at][:-1])))
            if follows.any():
                risky[follows] |= _ranks(model, made[np.flatnonzero(follows) - 1], made[follows])[0] <= least[at[follows]]
            several_ok = np.ones(len(starts) - 1, bool)
            several_ok[word[at[risky]]] = False
            # different pairs of one rank: leave the order to single merges
            mixed = np.concatenate(([False], (word[at][1:] == word[at][:-1]) & (made[1:] != made[:-1])))
            several_ok[word[at[mixed]]] = False
            hit = np.where(several_ok[word], hit, leftmost)
        at = np.flatnonzero(hit)
        symbols[at] = out[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, word, rank, out = symbols[keep], word[keep], rank[keep], out[keep]
        at = at - np.arange(len(at))
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        changed[at[at > 0] - 1] = True
        changed[-1] = False
        stale = np.flatnonzero(changed)
    if not done:
        return np.zeros(0, np.int64), np.zeros(n_words + 1, np.int64)
    words = np.concatenate([w for w, _ in done])
    flat = np.concatenate([s for _, s in done])
    order = np.argsort(words, kind="stable")
    return flat[order], np.concatenate(([0], np.cumsum(np.bincount(words, minlength=n_words))))


class Encoder:
    """Encodes texts with a memory of words, and decodes ids."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        self.model, self.most = PieceModel(path), most_words
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols = self.model.of_point[points].astype(np.int64)
        outside = np.flatnonzero(symbols < 0)
        symbols[outside] = -np.arange(1, len(outside) + 1)
        rare = [chr(c) for c in points[outside].tolist()]
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        flat, starts = merge_words(self.model, symbols, starts)
        if rare:  # characters outside the vocabulary become their bytes
            spelled = [[self.model.byte_ids[b] for b in c.encode()] for c in rare]
            counts = np.ones(len(flat), np.int64)
            odd = np.flatnonzero(flat < 0)
            counts[odd] = [len(spelled[-s - 1]) for s in flat[odd].tolist()]
            at = np.concatenate(([0], np.cumsum(counts)))
            wide = np.repeat(flat, counts)
            for i, s in zip(at[odd].tolist(), flat[odd].tolist()):
                wide[i : i + len(spelled[-s - 1])] = spelled[-s - 1]
            flat, starts = wide, at[starts]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.concatenate((self.starts, starts[1:] + self.starts[-1]))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the n + 1 offsets of the texts in them."""
        if len(self.known) > self.most:
            self.forget()
        split = [_RUN.findall(SPACE_MARK + t.replace(" ", SPACE_MARK)) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if new:
            self._learn(list(new))
        known = self.known
        where = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        sizes = self.starts[where + 1] - self.starts[where]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[where] - (ends - sizes), sizes) + np.arange(total)]
        per_text = np.concatenate(([0], np.cumsum([len(ws) for ws in split]))).astype(np.int64)
        return ids, np.concatenate(([0], ends))[per_text]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, without that of the dummy prefix; bytes that aren't UTF-8 become U+FFFD."""
        body = b"".join(map(self.model.piece_bytes.__getitem__, ids))
        return body.removeprefix(b" ").decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each task and model; forget_encoders() ends it."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    _encoders.clear()


def text_slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_column(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array of int) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            for a, b in text_slices(texts):
                ids, at = enc.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, "doc_id long, ids array<int>", then=forget_encoders)


def decode_column(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            texts = [enc.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").transform(map_arrow, run, "doc_id long, text string", then=forget_encoders)


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, without moving the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        decimal = enc.model.decimal.__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            for a, b in text_slices(texts):
                flat, at = enc.encode(texts[a:b])
                ids = [x.tolist() for x in np.split(flat, at[1:-1])]
                digests = ([sha(",".join(map(decimal, x))) for x in ids], [sha(enc.decode(x)) for x in ids])
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(at), pa.int64()), *(pa.array(d, pa.string()) for d in digests)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", then=forget_encoders)


def op2_piece_round_trip(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded with the 32k piece model."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
