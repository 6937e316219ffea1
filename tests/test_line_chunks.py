"""Chunks of lines that are rows against a fold over the lines."""

import random
from collections import Counter

from cloakwork.operators.line_chunks import line_chunks, with_chunks


def folded(sizes, budget):
    """Chunk of each line: (number, …)."""
    out, size, chunk = [], -1, 0
    for n in sizes:
        if size >= 0 and size + n > budget:
            chunk, size = chunk + 1, 0
        size = max(size, 0) + n
        out.append(chunk)
    return out


def test_lines_as_rows_equal_the_fold(spark):
    r = random.Random(12)
    for budget in (5, 30):
        rows, want = [], {}
        for doc_id in [*range(25), None, 2**53 + 1]:
            texts = [None if r.random() < 0.1 else "x" * r.choice([0, 1, 2, 3, 9, 40, budget - 1, budget]) for _ in range(r.randint(1, 60))]
            rows += [(doc_id, 2 * i + 1, t, "other") for i, t in enumerate(texts)]
            for i, c in enumerate(folded([len(t or "") + 1 for t in texts], budget)):
                want[doc_id, 2 * i + 1] = c
        r.shuffle(rows)
        table = spark.createDataFrame(rows, "doc_id long, line_no long, text string, next string")
        assert {(x["doc_id"], x["line_no"]): x["chunk_no"] for x in with_chunks(table, budget, bucket=8).collect()} == want
        assert {(x["doc_id"], x["chunk_no"]): x["n_lines"] for x in line_chunks(table, budget).collect()} == Counter((d, c) for (d, _), c in want.items())
    assert line_chunks(table.limit(0), 5).count() == 0


def test_one_text_of_many_lines(spark):
    table = spark.range(100_000).selectExpr("1L AS doc_id", "id AS line_no", "repeat('x', cast(id % 50 AS int)) AS text")
    want = folded([i % 50 + 1 for i in range(100_000)], 3_000)
    got = line_chunks(table, 3_000).collect()
    assert {r["chunk_no"]: r["n_lines"] for r in got} == Counter(want) and len(got) > 800
