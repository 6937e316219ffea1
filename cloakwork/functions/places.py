"""Where all values of a document stand in its text, in one pass of an automaton for each document.

Text and values are folded character by character (two characters that match without regard to case fold to one) and
runs of white space count as one space; an Aho-Corasick automaton of the folded values then gives every place of every
value as the text goes by, so work grows with the text and its matches, not with their product. Counts, forms, places
and surroundings are those of functions.text.locate and snippet.

Up to FEW values are sought one by one instead, which reads the text so many times at most and needs no automaton; the
results are the same.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate, pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cloakwork.functions.text import RADIUS
from cloakwork.patterns import PY_WS

#: So many words are sought one after the other; more, all at once by an automaton.
FEW = 128
_RUN, _LONG_RUN = re.compile(f"{PY_WS}+"), re.compile(f"{PY_WS}{{2,}}")
_ONE = "count: bigint, exact: string, index: int, context: string, {}: boolean"
SCHEMA = "hits array<struct<" + _ONE.format("alone") + ">>, given array<struct<" + _ONE.format("agrees") + ">>"
_COVERED = (0, None, -1, "", False)
_FIELDS = [("count", pa.int64()), ("exact", pa.string()), ("index", pa.int32()), ("context", pa.string())]


class _Fold(dict):
    """Code point → the one that stands for all that match it in any case: simple upper case, then simple lower case."""

    def __missing__(self, point: int) -> int:
        upper = chr(point).upper()
        if len(upper) > 1:
            upper = chr(point).title() if len(chr(point).title()) == 1 else chr(point)
        lower = upper.lower()
        self[point] = found = ord(lower[0])  # of a dotted capital I, the small i
        return found


_fold = _Fold()


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_fold)


def collapsed(text: str) -> str:
    return text if text.isprintable() and "  " not in text else _RUN.sub(" ", text)  # no other white space can be printed


class Text:
    """A text, folded and with one space for each run of white space, and the way back to its own places."""

    def __init__(self, text: str):
        self.text = text
        self.tight = collapsed(text)
        self.folded = fold(self.tight)
        self.at, self.shift = [0], [0]
        for m in _LONG_RUN.finditer(text) if len(self.tight) < len(text) else ():
            self.at.append(m.start() - self.shift[-1] + 1)  # from the sign after the run's one space
            self.shift.append(self.shift[-1] + m.end() - m.start() - 1)

    def place(self, i: int) -> int:
        return i + self.shift[bisect_right(self.at, i) - 1] if len(self.at) > 1 else i

    def form(self, at: int, n: int) -> tuple[str, int]:
        """The n signs at a folded place as they stand there, and their place in the text."""
        begin = self.place(at)
        return (self.tight[at : at + n] if len(self.at) == 1 else collapsed(self.text[begin : self.place(at + n - 1) + 1])), begin

    def around(self, index: int, length: int) -> str:
        """The value at index with its surroundings, marked."""
        start = max(0, index - RADIUS)
        if len(self.at) == 1:
            t, end = self.tight, index + length
            return f"{'…' if start else ''}{t[start:index]}«{t[index:end]}»{t[end : end + RADIUS]}{'…' if len(t) > end + RADIUS else ''}".strip(" ")
        at, most = index - start, index + length + RADIUS - start
        w = self.text[start : start + most + 1]
        body = f"{collapsed(w[:at])}«{collapsed(w[at : at + length])}»{collapsed(w[at + length : most])}"
        return (("…" if start else "") + body + ("…" if len(w) > most else "")).strip(" ")


def automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in words:
        if w:
            found.add_word(w, w)
    found.make_automaton()
    return found


def matches(known: ahocorasick.Automaton, text: str) -> Iterable[tuple[int, str]]:
    return known.iter(text) if len(known) else ()


def places(text: Text, words: set[str]) -> dict[str, tuple[int, int]]:
    """For each folded word that is in the text: how often, without overlaps from the left, and its first place there."""
    if len(words) <= FEW:
        folded = text.folded
        return {w: (folded.count(w, at), at) for w in words if w and (at := folded.find(w)) >= 0}
    found: dict[str, list[int]] = {}  # count, first place, end of the last
    for last, word in matches(automaton(words), text.folded):
        begin = last - len(word) + 1
        if (seen := found.get(word)) is None:
            found[word] = [1, begin, last]
        elif begin > seen[2]:
            seen[0] += 1
            seen[2] = last
    return {w: (n, at) for w, (n, at, _) in found.items()}


def contained_first(keys: list[str]) -> dict[str, int]:
    """For each key, the number of the first key that contains it, be it itself."""
    first: dict[str, int] = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    joined = "\n".join(keys)
    if len(keys) <= FEW and joined.count("\n") == len(keys) - 1:
        starts = [0, *accumulate(len(k) + 1 for k in keys)]
        return {k: bisect_right(starts, joined.find(k)) - 1 if k else i for k, i in first.items()}
    known, least = automaton(first), dict(first)
    for k, i in first.items():
        for _, inner in matches(known, k):
            if i < least[inner]:
                least[inner] = i
    return least


def located(body: str, hits: list[dict], given: list[dict]) -> tuple[list[tuple], list[tuple]]:
    """count, exact, index, context and a flag of every hit and suggestion (value and key) of one text.

    agrees: the suggestion's form holds a hit's key. alone: no suggestion has the hit's key or, being in the text, holds
    it, and no earlier hit's key does. Only hits that are alone are sought; of the others nothing but the flag counts.
    """
    return _located(body, *([x[f] for x in items] for items in (hits, given) for f in ("value", "key")))


def _located(body: str, values: list[str], keys: list[str], given: list[str], given_keys: list[str]) -> tuple[list[tuple], list[tuple]]:
    text = Text(body)
    wanted = [fold(collapsed(g)) for g in given]
    least = contained_first(keys)
    of_given, covered, found_given = places(text, set(wanted)), set(given_keys), []
    by_key = automaton(least) if len(least) > FEW else None

    def found(value: str, n: int, at: int) -> tuple[int, str, int, str]:
        exact, begin = text.form(at, len(value))
        return n, exact, begin, text.around(begin, len(exact))

    for g, want in zip(given, wanted):
        one = found(want, *of_given[want]) if want in of_given else (0, g, -1, "")
        form = collapsed(one[1]).strip(" ").lower()
        inside = {k for k in least if k and k in form} if by_key is None else {k for _, k in matches(by_key, form)}
        if one[0]:
            covered |= inside
        found_given.append((*one, bool(inside)))
    wanted = [fold(collapsed(v)) if least[k] >= i and k not in covered else "" for i, (v, k) in enumerate(zip(values, keys))]
    of_hits = places(text, set(wanted))
    return [(*found(w, *of_hits[w]), True) if w in of_hits else _COVERED for w in wanted], found_given


def _lists(rows: list[list[tuple]], flag: str) -> pa.Array:
    fields = [*_FIELDS, (flag, pa.bool_())]
    flat = [r for row in rows for r in row]
    columns = [pa.array([r[i] for r in flat], kind) for i, (_, kind) in enumerate(fields)]
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=[n for n, _ in fields]))


def _rows(column: pa.Array) -> list[tuple[list, list]]:
    """Values and keys of the items of each list; a null list is an empty one."""
    flat = column.flatten()
    values, keys = (flat.field(f).to_numpy(zero_copy_only=False).tolist() for f in ("value", "key"))
    ends = [0, *accumulate(n or 0 for n in column.value_lengths().to_pylist())]
    return [(values[a:b], keys[a:b]) for a, b in pairwise(ends)]


def located_all(text: Column, hits: Column, given: Column) -> Column:
    """struct(hits, given) of SCHEMA; hits and given: arrays of structs with value and key."""

    @arrow_udf(SCHEMA)
    def task(texts: pa.Array, hit_lists: pa.Array, given_lists: pa.Array) -> pa.Array:
        each = [_located(t or "", *h, *g) for t, h, g in zip(texts.to_pylist(), _rows(hit_lists), _rows(given_lists))]
        return pa.StructArray.from_arrays([_lists([e[0] for e in each], "alone"), _lists([e[1] for e in each], "agrees")], names=["hits", "given"])

    pair = lambda items: F.transform(items, lambda x: F.struct(x["value"].alias("value"), x["key"].alias("key")))
    return task(text, pair(hits), pair(given))
