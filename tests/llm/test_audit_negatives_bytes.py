"""Filter audit, hard negatives and forced-boundary BPE against plain computations, on the smallest tables and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import pairwise, permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import filter_audit, forced_bpe, hard_negatives
from tests.llm.test_training_ops import SCHEMA, odd_rows

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int, part string"


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    return con.execute(sql)


def plain_audit(docs, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    least = {}
    for r in docs:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    rows = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), doc_id is not None and doc_id > least[text])
        rows.append((lang or "", dict(zip("ABCDE", fails)), doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            for i, f in enumerate(order):
                here = [r for r in own if r[0][f] and not any(r[0][b] for b in order[:i])]
                total[f] += len(here)
                out[part, "".join(order), i + 1] = [
                    sum(not any(r[0][b] for b in order[: i + 1]) for r in own), len(here), sum(r[0][f] and any(r[0][b] for b in order[:i]) for r in own),
                    sum(r[0][f] and sum(r[0].values()) == 1 for r in own), sum(r[1] for r in here), sum(r[2] for r in here), f,
                ]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = total[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    return {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(filter_audit.joint_counts(filter_audit.failures(docs, labels))).collect()}


def test_filter_audit(spark):
    given = odd_rows() + [(500 + i, "same text", "en", None, None, "x", "y", "z", "k", "d", 3) for i in range(300)] + [(900, "LOUD $5", "", *[None] * 8)] * 2
    marks = [(7, 1, 0, "x"), (7, 0, 1, "y"), (14, None, 1, "x"), (520, 1, 1, "x"), (900, 0, 1, "x"), (12345, 1, 1, "z"), (None, 1, 1, "z")]
    docs, labels = spark.createDataFrame(given, SCHEMA), spark.createDataFrame(marks, LABELS)
    assert audited(docs, labels) == plain_audit(given, marks)
    assert audited(docs.limit(0), labels) == {}
    assert audited(docs, labels.limit(0)) == plain_audit(given, [])
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = plain_audit([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert audited(docs, labels) == want and len(want) == 4 * 600
    assert {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.op13_filter_audit(spark, SF).collect()} == want


def test_shapley_shares_add_up(spark):
    """Dividends give each order's removals back: over all filters they sum to 120 times the rows that fail any."""
    rows = spark.range(2000).selectExpr("'p' AS part", "cast(pmod(hash(id), 32) as int) AS mask", "id % 3 = 0 AS good", "id % 5 = 0 AS toxic")
    out = filter_audit.audit(filter_audit.joint_counts(rows)).collect()
    first = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in out}
    assert sum(first.values()) == 120 * rows.where("mask <> 0").count()


def plain_negatives(rows):
    """The contract of op11, row by row; rows: vec_id, label, vector."""
    own = [(i, v, (x + 1) % 10 if v % 7 == 0 else x, [math.floor(256 * float(c)) for c in q]) for i, (v, x, q) in enumerate(rows) if v is not None and x is not None and q is not None and all(c is not None and math.isfinite(c) for c in q)]
    score = lambda p, q: sum(a * b for a, b in zip(p, q))
    out = []
    for i, v, x, q in own:
        if v % 100:
            continue
        others = [(-score(q, r[3]), r[1], r[2] == x) for r in own if r[0] != i]
        for s, p, _ in sorted(o for o in others if o[2])[:5]:
            near = sorted((n, w) for n, w, same in others if not same and 80 * -s <= 100 * -n <= 100 * -s)
            out += [(v, p, k, w, -s, -n) for k, (n, w) in enumerate(near[:5], 1)]
    return sorted(out)


def odd_vectors():
    r = random.Random(3)
    base = [[r.gauss(0, 0.2) for _ in range(12)] for _ in range(40)]
    rows = [(i, r.randrange(10), list(base[r.randrange(40)]) if i % 3 else [r.gauss(0, 0.2) for _ in range(12)]) for i in range(700)]
    rows += [(700 + i, i % 2, [0.5] * 12) for i in range(400)]  # ties, and a third of all rows
    rows += [(100, 1, base[0]), (100, 1, base[0]), (201, 2, base[1]), (None, 1, base[0]), (1500, None, base[0]), (1600, 1, None), (1700, 1, [0.1, None] * 6), (1800, 1, [float("nan")] * 12), (1900, 2, [float("inf")] * 12)]
    return rows + [(2000, 2, [0.5] * 5), (2001, 2, []), (2100, 3, [0.0] * 12), (2101, 3, [-0.5] * 12), (2200, 8, [-1e-9] * 12)]


def mined(spark, rows, monkeypatch=None):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"row": F.lit("x"), "codes": F.lit(1), "anchor": F.lit("y"), "rank": F.lit(2)})
    path = f"{hard_negatives.shared_dir(spark)}/vectors-{len(rows)}-{random.random()}"
    table.write.parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, path).collect()))


def test_hard_negatives(spark, monkeypatch):
    rows = odd_vectors()
    want = plain_negatives(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1500)  # several blocks of anchors, small pieces, few cells learned
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 37)
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 3)
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", 20)
    assert mined(spark, rows) == want


def test_hard_negatives_of_large_components(spark):
    r = random.Random(5)
    rows = [(i, i % 3, [r.uniform(-4e5, 4e5) for _ in range(6)]) for i in range(0, 1200, 5)]
    assert mined(spark, rows) == plain_negatives(rows)
    assert hard_negatives.inner_products(np.array([[2.0**60, 1.0], [2.0**30, 1.0]]), np.array([[2.0**60, 1.0], [2.0**30, 1.0]])).tolist() == [2**63 - 1, 2**60 + 1]


def test_hard_negatives_without_rows(spark):
    for rows in ([], [(100, 1, None)], [(100, 1, [0.5])], [(1, 1, [0.5]), (2, 1, [0.5])]):
        assert mined(spark, rows) == []


def test_negatives_equal_sql_and_need_few_exact_scores(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    arrow = table.toArrow()
    assert sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, SF).collect())) == sorted(by_sql(hard_negatives.OP11_SQL, embeddings=arrow).fetchall())
    # the file leaves out most rows: of 20,000 random vectors under 5 % are scored for an anchor
    vectors = np.floor(256 * np.random.default_rng(1).normal(0, 0.125, (20_000, 64)))
    cells = hard_negatives.Cells(np.quantile(vectors, np.arange(hard_negatives.CELLS + 1) / hard_negatives.CELLS, axis=0).T, "<i2")
    bound = hard_negatives.bounds(cells.tables(vectors[:4]), cells.codes(vectors))
    exact = vectors @ vectors[:4].T
    assert (bound.real <= exact).all() and (exact <= bound.imag).all()
    assert ((bound.imag >= np.sort(bound.real, axis=0)[-6]).mean(axis=0) < 0.05).all()


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def assert_encodes(path, library, texts):
    enc = forced_bpe.ForcedEncoder(path)
    ids, at = enc.encode(pa.array(texts, pa.string()), None)
    body, ends = enc.decode(ids, at)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in pairwise(at.tolist())] == want
    assert [body[a:b].decode("utf-8", "replace") for a, b in pairwise(ends.tolist())] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_every_character(path, library):
    signs = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    assert_encodes(path, library, signs + [f"a{c} b {c}{c}1 '{c}s" for c in signs])


def test_mixed_and_long_texts(path, library):
    r = random.Random(1)
    signs = [*"aAbst'’ \t\n\r123,.<|>éüß日😀\xa0 \x1c\x85", "  ", "'s", "'ll", "<|endoftext|>", " <|endoftext|> ", "the ", " of", ""]
    assert_encodes(path, library, ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(20_000)])
    assert_encodes(path, library, [None, "", "a" * 200_001, "aA" * 20_000, "".join(r.choices("abcdefgh", k=30_000)), "\n" * 5_000, "x" + " " * 3_000, "<|endoftext|>" * 300, "é" * 9_999])


def test_cuts_lie_inside_no_token(path, library):
    v = forced_bpe.Vocabulary(path)
    assert not v.inside[ord("a"), ord(" ")] and v.inside[ord("t"), ord("h")]
    pieces = pa.array(["qZqthe", "the", "", "xqzjkwv"])
    found, counts = v.fragments(pieces)
    assert b"".join(found.to_pylist()) == b"qZqthethexqzjkwv" and counts.sum() == len(found) and counts[2] == 0 and counts[0] > 1
    whole = [i for p in pieces.to_pylist() if p for i in library.encode(p).ids]
    ids, _ = v.merged(found)
    assert ids.tolist() == whole
    heap = [i for f in found.to_pylist() for i in v._by_heap([int(v.single[b]) for b in f])]
    assert heap == whole


def test_forced_bpe_of_tables(spark, path, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [2**53 + 1, None, -1, 3]
    odd = spark.createDataFrame(odd_rows() + [(i, "id  beside a null", *[None] * 9) for i in ids], SCHEMA)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    key = lambda r: repr(tuple(r))
    for table in (docs, odd.coalesce(1), odd.limit(0)):
        want = []
        for r in table.collect():
            own = library.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((r["doc_id"], len(own), sha(b"".join(i.to_bytes(4, "little") for i in own)), sha(library.decode(own, skip_special_tokens=False).encode())))
        assert sorted(map(tuple, forced_bpe.round_trip(table, path).collect()), key=key) == sorted(want, key=key)
        encoded = forced_bpe.encode_column(table, path)
        texts = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), key=key)
        assert sorted(map(tuple, forced_bpe.decode_column(encoded, path).collect()), key=key) == texts
    assert forced_bpe.decode_column(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).collect()[0]["text"] == ""
